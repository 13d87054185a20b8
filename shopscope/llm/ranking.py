"""Ranked lexical search: all documents for each item, by bags instead of documents.

A document's score depends on two things only: how often it holds each term of the items (its tf
vector, restricted to the items' vocabulary) and its length factor m. So

1. one pass counts each document's terms, its tf vector (sorted pairs of term number and count) and, a task
   at a time, the documents that hold each term;
2. documents with the same hash of the vector and the same m meet, and classes are told apart by the
   vector itself (hash, then verify). Of each class the ``TOP`` smallest doc_ids stay, which each task
   prunes before the exchange: a list of ``TOP`` can't show more members of one class;
3. every class is scored once, for all items: weights times tf parts is a product of matrices whose entries are
   integers below 2**53, so it is exact. A task sends its ``TOP`` best classes of each item as one row;
   at most ``TOP`` classes can reach an item's list (each holds a better or earlier document);
4. the best classes' members are listed by score, then ascending doc_id.

Items are a stated query set in blocks of at most ``BLOCK_WORDS`` words; for each block all documents
are scored. Nothing but a block, its document frequencies and the corpus totals reaches the driver.

Null or empty texts and texts without terms score nothing and don't count. Repeated documents are ranked
one by one, documents without an id after those with one. Each row of items is ranked by itself, items
without terms have no rows. Empty tables: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopscope.llm.common import staged, text_rows
from shopscope.llm.terms import hashed_rows, item_blocks, word_numbers

TOP = 50
BLOCK_WORDS = 1 << 18
#: Numbers in one dense matrix of a task (items x terms, or classes x terms).
CELLS = 1 << 22
#: Items with more different terms than this are added up in 64-bit integers instead of doubles.
EXACT_TERMS = 1 << 17

_BAGS = "kind byte, doc_id long, n long, bag binary, df array<long>"
_BEST = "item long, best binary"
_CLASS = np.dtype([("score", "<i8"), ("named", "<i8"), ("doc", "<i8"), ("h", "<i8"), ("m", "<i8")])


def _bags(vocabulary):
    """kind 0: a document's number of terms and its tf vector; kind 1, one for a task: [documents with a
    term, all terms, documents that hold each term of the vocabulary]."""
    def run(batches):
        voc = vocabulary.value
        held, docs, total = np.zeros(len(voc), np.int64), 0, 0
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, h, row in hashed_rows(b):
                n = np.bincount(row, minlength=hi - lo)
                docs, total = docs + int((n > 0).sum()), total + len(h)
                number = word_numbers(h, voc)
                known = np.flatnonzero(number >= 0)
                key, tf = np.unique(row[known] * np.int64(len(voc) + 1) + number[known], return_counts=True)
                doc, term = np.divmod(key, np.int64(len(voc) + 1))
                held += np.bincount(term, minlength=len(voc))
                body = np.stack((term, tf), axis=1).astype("<i4")
                offs = (np.searchsorted(doc, np.arange(hi - lo + 1)) * 8).astype(np.int32)
                bag = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offs), pa.py_buffer(body.tobytes())])
                yield _bag_rows(0, ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), bag, pa.nulls(hi - lo, pa.list_(pa.int64())))
        none = pa.nulls(1, pa.int64())
        yield _bag_rows(1, none, none, pa.nulls(1, pa.binary()), pa.array([[docs, total, *held.tolist()]], pa.list_(pa.int64())))

    return run


def _bag_rows(kind, ids, n, bag, df):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), ids, n, bag, df],
                                      names=["kind", "doc_id", "n", "bag", "df"])


class _Scorer:
    """Items of a block in groups whose matrix (items x terms of the group) has at most CELLS numbers."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.weights, self.n_items = weights, len(items)
        self.groups, at = [], 0
        while at < len(items):
            end, terms = at + 1, set(items[at].tolist())
            while end < len(items):
                more = terms | set(items[end].tolist())
                if len(more) * (end + 1 - at) > CELLS:
                    break
                terms, end = more, end + 1
            self.groups.append((at, end, np.array(sorted(terms), dtype=np.int64)))
            at = end
        self.items = items

    def matrix(self, group) -> np.ndarray:
        at, end, terms = group
        kind = np.int64 if any(len(x) > EXACT_TERMS for x in self.items[at:end]) else np.float64
        out = np.zeros((len(terms), end - at), dtype=kind)
        for i in range(at, end):
            out[np.searchsorted(terms, self.items[i]), i - at] = 1
        return out

    def scores(self, group, matrix, row, term, part, n):
        """Scores (n classes x items of the group) from each class's parts."""
        terms = group[2]
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        mine = terms[at] == term
        dense = np.zeros((n, len(terms)), dtype=matrix.dtype)
        dense[row[mine], at[mine]] = part[mine]
        return (dense @ matrix).astype(np.int64)


def _best(held: np.ndarray, top: int) -> np.ndarray:
    order = np.lexsort((held["doc"], 1 - held["named"], -held["score"]))
    return held[order[:top]]


def _scored(scorer, top):
    def run(batches):
        s = scorer.value
        best = [np.zeros(0, _CLASS) for _ in range(s.n_items)]
        least = np.zeros(s.n_items, np.int64)
        kept = {}
        for b in batches:
            bags, m_all = b.column("bag"), b.column("m").to_numpy(zero_copy_only=False)
            names = np.zeros(b.num_rows, dtype=_CLASS)
            names["h"], names["m"] = b.column("h").to_numpy(zero_copy_only=False), m_all
            names["named"] = np.array(b.column("doc_id").is_valid())
            names["doc"] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            sizes = np.array(pa.compute.binary_length(bags)) // 8
            pairs = np.frombuffer(b"".join(x.as_buffer() for x in bags), "<i4").reshape(-1, 2).astype(np.int64)
            border = np.concatenate(([0], np.cumsum(sizes)))
            for g, group in enumerate(s.groups):
                if g not in kept:
                    kept = {g: s.matrix(group)}
                step = max(1, CELLS // max(1, len(group[2])))
                for lo in range(0, b.num_rows, step):
                    hi = min(b.num_rows, lo + step)
                    row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                    term, tf = pairs[border[lo]:border[hi]].T
                    part = s.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m_all[lo:hi][row]))
                    score = s.scores(group, kept[g], row, term, part, hi - lo)
                    for i in np.flatnonzero((score >= np.maximum(least[group[0]:group[1]], 1)).any(axis=0)).tolist():
                        item = group[0] + i
                        take = np.flatnonzero(score[:, i] >= max(1, least[item]))
                        new = names[lo:hi][take].copy()
                        new["score"] = score[take, i]
                        best[item] = _best(np.concatenate((best[item], new)), top)
                        if len(best[item]) == top:
                            least[item] = best[item]["score"][-1]
        some = [i for i in range(s.n_items) if len(best[i])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([best[i].tobytes() for i in some], pa.binary())],
                                         names=["item", "best"])

    return run


def _merged(top):
    """The best classes of each item of a task's rows; memory holds one short list an item."""
    def run(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for item, blob in zip(b.column("item").to_pylist(), b.column("best")):
                new = np.frombuffer(blob.as_buffer(), _CLASS)
                best[item] = _best(np.concatenate((best[item], new)), top) if item in best else new
        for item, x in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), item, np.int64)), pa.array(x["score"]), pa.array(x["h"]), pa.array(x["m"]),
                 pa.array(x["doc"], mask=x["named"] == 0)], names=["item", "score", "h", "m", "first_id"])

    return run


def _ranked_block(docs: DataFrame, ids: list, words: list[np.ndarray], top: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary = np.unique(np.concatenate(words))
    items = [np.unique(word_numbers(w, vocabulary)) for w in words]
    bags = staged(text_rows(docs).mapInArrow(_bags(sc.broadcast(vocabulary)), _BAGS), "rank-bags")
    counted = bags.where("kind = 1").select(F.posexplode("df").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    sums = dict(counted.collect())  # two totals and one number for each term of the block
    n_docs, n_terms = sums.get(0, 0), sums.get(1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(i + 2, 0) + 1)))
                        for i in range(len(vocabulary))], dtype=np.int64)
    m = F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {max(1, n_terms)}L)").alias("m")
    own = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = bags.where("kind = 0 and octet_length(bag) > 0").select("doc_id", m, F.xxhash64("bag").alias("h"), "bag") \
        .withColumns({"place": F.row_number().over(own), "first_id": F.first("doc_id").over(own)}).where(F.col("place") <= top)
    members = staged(members, "rank-classes")
    scorer = sc.broadcast(_Scorer(items, weights))
    found = members.where("place = 1").select("h", "m", "bag", "doc_id").mapInArrow(_scored(scorer, top), _BEST) \
        .repartition(max(1, min(len(ids), int(spark.conf.get("spark.sql.shuffle.partitions")))), "item") \
        .mapInArrow(_merged(top), "item long, score long, h long, m long, first_id long")
    found = staged(found, "rank-best")
    f, c = found.alias("f"), members.alias("c")
    listed = f.join(c, (F.col("f.h") == F.col("c.h")) & (F.col("f.m") == F.col("c.m"))
                    & F.col("f.first_id").eqNullSafe(F.col("c.first_id"))).select("f.item", "f.score", "c.doc_id")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {_type(ids)}")
    return listed.withColumn("rank", rank).where(F.col("rank") <= top).join(named, "item") \
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _type(ids: list) -> str:
    return "string" if any(isinstance(i, str) for i in ids) else "long"


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for ids, words in item_blocks(items, BLOCK_WORDS):
        if sum(map(len, words)):
            block = _ranked_block(docs, ids, words, top)
            out = out.unionByName(block.withColumn("item_id", F.col("item_id").cast(kind)))
    return out


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), it AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), voc AS (SELECT DISTINCT term FROM it
), tot AS (SELECT count(*) AS nd, CAST(sum(len(ts)) AS BIGINT) AS nt FROM d WHERE len(ts) > 0
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN voc USING (term)
  GROUP BY doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot
), part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nt)))) AS part
  FROM tf JOIN w USING (term), tot
), score AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM it JOIN part USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 50
"""
