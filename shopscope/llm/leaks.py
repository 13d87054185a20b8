"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents into shards of at most ``SHARD_WORDS`` words and sorts the shard's suffixes
(word numbers, prefix doubling that only sorts again what is still equal; as deep as the longest item).
Every suffix of every item is then found by binary search: its interval of the array narrows word by
word, so the depth at which it empties is its longest verbatim match in the shard, and the interval before
that holds the places. A document is affected if a window (``WINDOW`` consecutive words of an item, or a
whole shorter item) occurs in it; the words of all occurrences are marked. No documents are exchanged.

The items are a stated query set, read in blocks of at most ``BLOCK_WORDS`` words. Only such a block is
broadcast or held at once by driver or task; each shard is sorted once and searched for every block.

Words are runs of 0-9, a-z and bytes from 0x80, A-Z lower-cased. Null or empty texts have no words: such
documents are clean, such items have no window. Items without an id count for marked words but can't be
listed; an id that stands on several rows is listed once. Repeated documents are judged one by one. A document
of more words than a shard is sorted in stretches that overlap by the longest item. Empty tables: empty
result, or no marked word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import text_rows
from shopscope.llm.terms import hashed_rows, item_blocks, word_numbers

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20

_HITS = "doc_id long, n_words long, n_hit long, items array<string>"
_LONGEST = "item_id string, item_word long, n_words long, doc_id long, doc_word long"


# ---------------------------------------------------------------- the query set

def query_block(ids: list, words: list[np.ndarray], window: int = WINDOW) -> dict:
    """One block of items: vocabulary, word numbers (from 1; 0 ends an item), each suffix's item, rest
    of words and window length (0: none), and the items of each different window."""
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    item = np.repeat(np.arange(len(words)), size)
    first = np.repeat(np.cumsum(size) - size, size)
    rest = np.repeat(size, size) - (np.arange(len(item)) - first)
    seq = word_numbers(np.concatenate(words), vocabulary) + 1 if words else np.zeros(0, np.int64)
    whole = np.repeat(size < window, size) & (np.arange(len(item)) == first)
    length = np.where(rest >= window, window, np.where(whole, rest, 0))
    # windows with the same words are one: named by their words
    known: dict[bytes, int] = {}
    name = np.full(len(item), -1, dtype=np.int64)
    for j in np.flatnonzero(length).tolist():
        name[j] = known.setdefault(seq[j:j + length[j]].tobytes(), len(known))
    at = np.flatnonzero(name >= 0)
    pairs = np.unique(np.stack((name[at], item[at]), axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    one = np.full(len(known), -1, dtype=np.int64)
    one[name[at][::-1]] = at[::-1]  # the first suffix of each window stands for it
    return {"ids": [None if i is None else str(i) for i in ids], "vocabulary": vocabulary, "seq": seq, "item": item,
            "offset": np.arange(len(item)) - first, "rest": rest, "one": one, "length": length,
            "window_items": pairs[:, 1], "window_at": np.searchsorted(pairs[:, 0], np.arange(len(known) + 1)),
            "deepest": int(size.max(initial=0))}


# ---------------------------------------------------------------- suffix array

def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of their suffixes, compared on ``depth`` words at least. Suffixes
    that reach a 0 in their first words stay unsorted from there on: no query holds a 0."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((ids, np.zeros(depth + 1, np.int64)))
    top = np.int64(int(ids.max()) + 1)
    key = ids * top + padded[1:n + 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    place = np.arange(n)
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.full(n + 1, -1, dtype=np.int64)  # the end is before all
    rank[order] = group
    zero = np.where(ids == 0, place, n)
    to_zero = np.minimum.accumulate(zero[::-1])[::-1] - place
    h = 2
    open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while h < depth and len(open_):
        open_ = open_[to_zero[order[open_]] >= h]
        p = order[open_]
        key = rank[p] * np.int64(n + 1) + rank[np.minimum(p + h, n)] + 1
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[open_] = p
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        rank[p] = np.maximum.accumulate(np.where(new, open_, 0)) if len(key) else 0
        single = new & np.concatenate((new[1:], [True])) if len(key) else new
        open_ = open_[~single]
        h *= 2
    return order


def search(ids: np.ndarray, order: np.ndarray, seq: np.ndarray, rest: np.ndarray, stops: np.ndarray):
    """Binary search of all suffixes of ``seq`` (suffix j has ``rest[j]`` words): (depth, low, high) of each
    one's longest match, and (low, high) of those that match on their ``stops[j]`` words (else 0, 0)."""
    m = len(seq)
    depth = np.zeros(m, np.int64)
    low, high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    at_low, at_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if not len(ids) or not m:
        return depth, low, high, at_low, at_high
    first = ids[order]
    padded = np.concatenate((ids, np.zeros(int(rest.max()) + 1, np.int64)))
    lo, hi = np.searchsorted(first, seq, "left"), np.searchsorted(first, seq, "right")
    live = np.flatnonzero(lo < hi)
    k = 1
    while len(live):
        lo, hi = (lo[live], hi[live]) if k == 1 else (lo, hi)
        depth[live], low[live], high[live] = k, lo, hi
        stop = stops[live] == k
        at_low[live[stop]], at_high[live[stop]] = lo[stop], hi[stop]
        more = rest[live] > k
        live, lo, hi = live[more], lo[more], hi[more]
        want = seq[live + k]
        new_lo = _bound(padded, order, lo, hi, want, k, False)
        new_hi = _bound(padded, order, new_lo, hi, want, k, True)
        some = new_lo < new_hi
        live, lo, hi = live[some], new_lo[some], new_hi[some]
        k += 1
    return depth, low, high, at_low, at_high


def _bound(padded, order, lo, hi, want, k, after):
    """First place in [lo, hi) whose suffix has at word k a number >= want (> want if ``after``)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            return lo
        mid = (lo[todo] + hi[todo]) >> 1
        x = padded[order[mid] + k]
        right = x <= want[todo] if after else x < want[todo]
        lo[todo] = np.where(right, mid + 1, lo[todo])
        hi[todo] = np.where(right, hi[todo], mid)


# ---------------------------------------------------------------- shards

def _numbered(hashes: np.ndarray, sizes: np.ndarray, block: dict) -> np.ndarray:
    """Word numbers of a shard's documents, each followed by a 0; words of no item are 0 too."""
    out = np.zeros(len(hashes) + len(sizes), dtype=np.int64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = word_numbers(hashes, block["vocabulary"]) + 1
    return out


def _stretches(total: int, deepest: int):
    """(start, end) of pieces of a shard; more than one only if it exceeds SHARD_WORDS."""
    at = 0
    while True:
        end = min(total, at + SHARD_WORDS + deepest)
        yield at, end
        if end == total:
            return
        at = end - deepest


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals, and the interval of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), which


def _searched(hashes, sizes, block):
    """(places, windows) of all occurrences in a shard and, per suffix, (depth, place) of its longest match."""
    ids = _numbered(hashes, sizes, block)
    spots, names = [], []
    depth = np.zeros(len(block["seq"]), np.int64)
    where = np.zeros(len(block["seq"]), np.int64)
    for a, e in _stretches(len(ids), block["deepest"]):
        order = suffix_array(ids[a:e], block["deepest"])
        d, lo, _, w_lo, w_hi = search(ids[a:e], order, block["seq"], block["rest"], block["length"])
        better = d > depth
        depth[better] = d[better]
        where[better] = order[lo[better]] + a
        one = block["one"]
        at, window = _spread(w_lo[one], w_hi[one])
        spots.append(order[at] + a)
        names.append(window)
    spot, name = np.concatenate(spots), np.concatenate(names)
    if len(spots) > 1:  # overlaps are seen twice
        spot, name = np.unique(np.stack((spot, name)), axis=1)
    return spot, name, depth, where


def _shards(batches):
    """(document ids, sizes, word hashes) of shards of whole documents."""
    ids, sizes, words, held = [], [], [], 0
    for b in batches:
        docs = b.column("doc_id").to_pylist()
        for lo, hi, h, row in hashed_rows(b):
            ids += docs[lo:hi]
            sizes.append(np.bincount(row, minlength=hi - lo))
            words.append(h)
            held += len(h)
            if held >= SHARD_WORDS:
                yield ids, np.concatenate(sizes), np.concatenate(words)
                ids, sizes, words, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(sizes), np.concatenate(words)


def _hits(blocks):
    def run(batches):
        for ids, sizes, hashes in _shards(batches):
            doc_of = np.repeat(np.arange(len(sizes)), sizes + 1)
            hit = np.zeros(len(doc_of), dtype=bool)
            found: dict[int, set] = {}
            for shared in blocks:
                block = shared.value
                spot, name, _, _ = _searched(hashes, sizes, block)
                step = np.zeros(len(doc_of) + 1, dtype=np.int64)
                np.add.at(step, spot, 1)
                np.add.at(step, spot + block["length"][block["one"]][name], -1)
                hit |= np.cumsum(step[:-1]) > 0
                pairs = np.unique(np.stack((doc_of[spot], name), axis=1), axis=0) if len(spot) else np.zeros((0, 2), np.int64)
                at, pair = _spread(block["window_at"][pairs[:, 1]], block["window_at"][pairs[:, 1] + 1])
                for d, i in zip(pairs[pair, 0].tolist(), block["window_items"][at].tolist()):
                    if block["ids"][i] is not None:
                        found.setdefault(d, set()).add(block["ids"][i])
                if len(blocks) > 1:
                    shared.unpersist_value()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)),
                 pa.array(np.bincount(doc_of[hit], minlength=len(sizes)).astype(np.int64)),
                 pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "items"])

    return run


def _longest(blocks):
    def run(batches):
        for ids, sizes, hashes in _shards(batches):
            ends = np.cumsum(sizes + 1)
            for shared in blocks:
                block = shared.value
                _, _, depth, where = _searched(hashes, sizes, block)
                order = np.lexsort((block["offset"], -depth, block["item"]))
                item = block["item"][order]
                best = order[np.concatenate(([True], item[1:] != item[:-1]))] if len(item) else order
                best = best[depth[best] > 0]
                doc = np.searchsorted(ends, where[best], "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["ids"][i] for i in block["item"][best].tolist()], pa.string()),
                     pa.array(block["offset"][best]), pa.array(depth[best]), pa.array([ids[d] for d in doc.tolist()], pa.int64()),
                     pa.array(where[best] - (ends - sizes - 1)[doc])],
                    names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])
                if len(blocks) > 1:
                    shared.unpersist_value()

    return run


class _Block:
    """A broadcast block of which a task holds the value only while it searches."""

    def __init__(self, shared):
        self.shared = shared

    @property
    def value(self):
        return self.shared.value

    def unpersist_value(self):
        self.shared.__dict__.pop("_value", None)


def _blocks(docs: DataFrame, items: DataFrame, window: int) -> list[_Block]:
    sc = docs.sparkSession.sparkContext
    return [_Block(sc.broadcast(query_block(ids, words, window))) for ids, words in item_blocks(items, BLOCK_WORDS)]


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words of each document inside a window of an item, and the ids
    (as strings, sorted) of the items whose windows occur."""
    return text_rows(docs).mapInArrow(_hits(_blocks(docs, items, window)), _HITS)


def longest_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): each item's longest verbatim match with a document,
    from which word of the item to which word of which document (ties: first word of the item, smallest
    doc_id, first word). Items without a common word are absent."""
    rows = text_rows(docs).mapInArrow(_longest(_blocks(docs, items, WINDOW)), _LONGEST)
    best = F.struct((-F.col("n_words")).alias("n"), "item_word", F.col("doc_id").isNull().alias("none"), "doc_id", "doc_word")
    return rows.where("item_id is not null").groupBy("item_id").agg(F.min(best).alias("b")).select(
        "item_id", "b.item_word", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_word")


def without_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns kept."""
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = text_rows(docs, key.alias("row_key"))
    marked = rows.mapInArrow(_marked(_blocks(docs, items, window)), "row_key long").distinct()
    return docs.join(marked, key == marked["row_key"], "left_anti")


def _marked(blocks):
    inner = _hits(blocks)

    def run(batches):
        for b in inner(x.select(["row_key", "text"]).rename_columns(["doc_id", "text"]) for x in batches):
            keep = b.filter(pa.compute.greater(b.column("n_hit"), 0))
            yield pa.RecordBatch.from_arrays([keep.column("doc_id")], names=["row_key"])

    return run


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(list_slice(ws, p, p + 9), ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS p FROM i WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM win
), grams AS (
  SELECT doc_id, p, size, array_to_string(list_slice(ws, p, p + size - 1), ' ') AS w
  FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS p FROM d, sizes WHERE len(ws) >= size)
), found AS (SELECT g.doc_id, g.p, g.size, win.item_id FROM grams g JOIN win ON g.size = win.size AND g.w = win.w
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
