"""Quality rules: fixed text rules, then a calibrated logistic regression on hashed n-grams.

Features are the shares of hashed words, pairs of consecutive words and strings of three characters in
a text, so a score doesn't depend on length. The regression is trained on at most ``SAMPLE`` rows that
``labels.quality`` marks (chosen by hash of doc_id, ``SAMPLE_BYTES`` bytes of text in all, none of more than a
sixteenth of that) and on the at most ``FEATURES`` features whose rows differ most in their labels. It is
calibrated on a held-out fifth of the sample (Platt) and scored over whole texts in Arrow batches. A document is kept if no rule fails and its probability of good quality
reaches ``KEEP_AT``. Without ten labels, or labels of both kinds, the rules alone decide.

Null text: no words, fails. Lines and windows are compared within one document only; repeated rows
are scored each for itself. Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopscope.llm import linear
from shopscope.llm.common import (mix64, prefix_hash, span_hash, text_rows, text_slices, tidy, window_hashes, words_of)

#: Labelled rows that the regression is trained on, at most, and their bytes of text together.
SAMPLE = 6000
SAMPLE_BYTES = 1 << 23
#: Features that the regression may use, and the least evidence (natural logarithm) of each.
FEATURES, EVIDENCE = 1 << 13, 4.0
#: Bits of a hashed feature: words, pairs of words, strings of CHARS characters lie one after another.
BITS, CHARS = 18, 3
DIM = 3 << BITS
#: Fixed thresholds.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Scale of the feature shares (conditions the solver; the model absorbs it).
SCALE = 10.0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


def _inside(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash that tells equal contents of different documents apart."""
    return h ^ mix64(doc.astype(np.uint64) + np.uint64(1))


def counts(data: np.ndarray, offs: np.ndarray, words, prefix: np.ndarray, wh: np.ndarray) -> list[np.ndarray]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] of every document of a slice."""
    s, e, d = words
    docs = len(offs) - 1
    n_words = np.bincount(d, minlength=docs)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[s] += 1
    in_word[e[e < len(data) + 1]] -= 1  # adjacent words of two documents share this place
    lead = (np.cumsum(in_word[:-1]) > 0) & ((data & 0xC0) != 0x80)
    # lines: cut at every line feed and at the documents' ends
    feed = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], feed + 1)))
    line_doc = np.searchsorted(offs, start, "right") - 1
    ok = (start < len(data)) & (line_doc < docs)
    start, line_doc = start[ok], line_doc[ok]
    stop = offs[line_doc + 1] if docs else start
    after = np.searchsorted(feed, start)
    end = np.minimum(np.where(after < len(feed), feed[np.minimum(after, max(len(feed) - 1, 0))] if len(feed) else len(data),
                              len(data)), stop)
    full = np.searchsorted(s, end) > np.searchsorted(s, start)
    start, end, line_doc = start[full], end[full], line_doc[full]
    key = _inside(span_hash(prefix, start, end), line_doc)
    _, first = np.unique(key, return_index=True)
    n_dup = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[first], minlength=docs)
    # words in windows that occur again
    h, at = window_hashes(wh, d, WINDOW)
    key = _inside(h, d[at])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(h) else at
    cover = np.zeros(len(s) + WINDOW + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    repeated = np.cumsum(cover)[:len(s)] > 0
    return [n_words, _per_doc(lead, offs), _per_doc(_SYMBOL[data], offs), n_dup,
            np.bincount(d[repeated], minlength=docs)]


def _slots(h: np.ndarray, block: int) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64) + (block << BITS)


def grams(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, document) of every string of CHARS characters of a slice."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(offs, lead, "right") - 1
    after = np.concatenate((lead, [len(data)]))
    n = len(lead) - CHARS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[CHARS - 1:])
    # a document's last string ends where the next document begins
    return _slots(span_hash(prefix, lead[whole], after[whole + CHARS]), 2), doc[whole]


def ngrams(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray, word_hash: np.ndarray, word_doc: np.ndarray):
    """Of words, pairs of words and strings of characters: (feature number, document) of all of a slice."""
    pair, at = window_hashes(word_hash, word_doc, 2)
    return ((_slots(word_hash, 0), word_doc), (_slots(pair, 1), word_doc[at]), grams(data, offs, prefix))


def _features(batch):
    """A slice at a time, (numbers, values) of each row's distinct features; a kind's values have the sum SCALE."""
    for _, _, data, offs in text_slices(batch):
        docs = len(offs) - 1
        s, e, d = words_of(data, offs)
        prefix = prefix_hash(data)
        parts = []
        for slot, doc in ngrams(data, offs, prefix, span_hash(prefix, s, e), d):
            n = np.bincount(doc, minlength=docs)
            key, times = np.unique(doc * np.int64(DIM) + slot, return_counts=True)
            doc, slot = np.divmod(key, np.int64(DIM))
            parts.append((slot, SCALE * times / n[doc], np.searchsorted(doc, np.arange(docs + 1))))
        yield [tuple(np.concatenate([p[k][p[2][i]:p[2][i + 1]] for p in parts]) for k in (0, 1)) for i in range(docs)]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> linear.Model:
    sample = linear.bounded_sample(text_rows(docs), labels, "quality", rows, most_bytes)
    wanted = linear.telling_features(sample, _features, EVIDENCE, FEATURES)
    return linear.fit(*linear.collected(sample, _features, wanted), dim=DIM)


def _score(model, place: int | None = None):
    """Counts and probability beside the other columns; the text is the column ``text``, which ends here, or
    field ``place`` of the column ``given``."""
    def run(batches):
        m = model.value
        weight = m.weight.astype(np.float64)
        for b in batches:
            cols = [[] for _ in range(6)]
            texts = b.column("text") if place is None else b.column("given").flatten()[place].cast(pa.string())
            for _, _, data, offs in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                words = s, e, d = words_of(data, offs)
                prefix = prefix_hash(data)
                wh = span_hash(prefix, s, e)
                docs = len(offs) - 1
                base = counts(data, offs, words, prefix, wh)
                dot = np.zeros(docs)
                for slot, doc in ngrams(data, offs, prefix, wh, d):
                    dot += np.bincount(doc, weight[slot], minlength=docs) / np.maximum(np.bincount(doc, minlength=docs), 1)
                for c, x in zip(cols, (*base, m.probability(SCALE * dot))):
                    c.append(x)
            joined = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            arrays = [pa.array(x.astype(np.int64)) for x in joined[:5]] + [pa.array(joined[5].astype(np.float64))]
            own = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in own], *arrays],
                                             names=[*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality"])

    return tidy(run)


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double"


def _judged(rows: DataFrame, model: linear.Model) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT if model.fitted else F.lit(True)))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, quality, base_failed, kept) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return _judged(text_rows(docs).mapInArrow(_score(model), f"doc_id long, {_COUNTS}"), model.value)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the input's own columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text_rows(docs)
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("given"))
    place = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*given.schema.fields, *T.StructType.fromDDL(_COUNTS).fields])
    return _judged(given.mapInArrow(_score(model, place), schema), model.value).where("kept").select("given.*")
