"""Words of letters and digits (0-9, a-z and all bytes from 0x80, A-Z lower-cased) as 64-bit hashes,
and vocabularies of query tables in blocks of bounded size.

Equal words have equal hashes; different words are told apart by 64 bits (at 10**6 query words and
10**9 different document words about one wrong pair in 20,000 corpora is expected).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import SLICE_BYTES, lower_ascii, prefix_hash, ship_package, span_hash, text_slices, words_of

#: True for bytes that belong to no word, after A-Z are lower-cased.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[0x30:0x3A] = False
BETWEEN[0x61:0x7B] = False
BETWEEN[0x80:] = False


def _stretch(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(data)
    start, end, row = words_of(low, offs, BETWEEN)
    return span_hash(prefix_hash(low), start, end), row


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a slice; a long slice is read in stretches that end between words."""
    if len(data) <= 2 * SLICE_BYTES:
        return _stretch(data, offs)
    parts, at = [], 0
    gaps = np.flatnonzero(BETWEEN[lower_ascii(data)])
    while at < len(data):
        cut = len(data)
        if cut - at > 2 * SLICE_BYTES:
            g = np.searchsorted(gaps, at + SLICE_BYTES)
            cut = int(gaps[g]) if g < len(gaps) else cut
        inner = offs[(offs > at) & (offs < cut)]
        h, row = _stretch(data[at:cut], np.concatenate(([at], inner, [cut])) - at)
        parts.append((h, row + np.searchsorted(offs, at, "right") - 1))
        at = cut
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def word_numbers(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted vocabulary, -1 if it isn't there."""
    if not len(vocabulary):
        return np.full(len(h), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def item_blocks(items: DataFrame, most_words: int, key: str = "item_id") -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes of each) of consecutive items with at most ``most_words`` words together (one
    longer item is a block of its own). The driver holds one block at a time."""
    ship_package(items.sparkSession)
    ids, words, size = [], [], 0
    for r in items.select(F.col(key).alias("k"), F.col("text").cast("string").alias("t")).toLocalIterator():
        raw = np.frombuffer((r["t"] or "").encode(), dtype=np.uint8)
        h, _ = hashed_words(raw, np.array([0, len(raw)]))
        if ids and size + len(h) > most_words:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(r["k"])
        words.append(h)
        size += len(h)
    if ids:
        yield ids, words


def hashed_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row of each word) of the slices of a batch."""
    for lo, hi, data, offs in text_slices(batch):
        h, row = hashed_words(data, offs)
        yield lo, hi, h, row
