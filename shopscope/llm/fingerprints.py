"""Document fingerprints by content-defined chunking.

Texts (as UTF-8) are cut where a gear hash of the last 32 bytes falls below a bound. Chunking is
normalised: up to ``NORMAL`` bytes the bound is strict, beyond it loose, so sizes stay near the middle;
no chunk but the last is shorter than ``LEAST`` or longer than ``MOST``. Cuts depend on nearby bytes only,
so they survive insertions and deletions elsewhere. A fingerprint is the sorted set of the chunks'
48-bit digests with their lengths. Likeness is containment: the share of the one fingerprint's bytes in
chunks that the other has too (1 for two empty texts, 0 if one is empty).

The next document is found without a global window: ranges of doc_id are cut at ids that occur, so the
first document of a range is known before the exchange and goes to the range before it as well; the
first of all goes to the last range. One exchange by range, then each range is read in order.

Null texts are empty. Rows with the same id follow each other, ordered by text. Rows without an id have
no place in the order: their next document is the empty text, and they are nobody's next. Empty input:
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import SLICE_BYTES, partitions, prefix_hash, span_hash, text_rows

LEAST, NORMAL, MOST = 32, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3) >> np.uint64(24)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash (h = 2 h + table[byte], 32 bits, so of the last 32 bytes) at every place."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        later = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate((h[:step], later))
    return h


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, number of chunks of each text)."""
    h = gear(data)
    places = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = (h[places] >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    first = np.searchsorted(places, offs).tolist()
    places = (places + 1).tolist()  # a chunk ends behind the place
    ends, counts = [], []
    offs = offs.tolist()
    for i in range(len(offs) - 1):
        at, stop, before = offs[i], offs[i + 1], len(ends)
        k, last = first[i], first[i + 1]
        while stop - at > LEAST:
            low, middle, high = at + LEAST, at + NORMAL, min(at + MOST, stop)
            while k < last and places[k] < low:
                k += 1
            while k < last and places[k] < middle and not strict[k]:
                k += 1
            at = places[k] if k < last and places[k] < high else high
            ends.append(at)
        if stop > at:
            ends.append(stop)
        counts.append(len(ends) - before)
    return np.array(ends, dtype=np.int64), np.array(counts, dtype=np.int64)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct (48-bit digest << 8 | length - 1) of every text's chunks."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    ends, counts = chunk_ends(data, offs)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    h = span_hash(prefix_hash(data), starts, ends)
    code = h >> np.uint64(16) << np.uint64(8) | (ends - starts - 1).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(counts)))
    return [np.unique(code[i:j]) for i, j in zip(at, at[1:])]


def written(code: np.ndarray) -> str:
    """14 hex digits for each chunk."""
    return code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    return np.pad(raw, ((0, 0), (1, 0))).view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes (distinct chunks) that b's fingerprint has too."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    size = (a & np.uint64(255)).astype(np.int64) + 1
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(size[b[at] == a].sum() / size.sum())


def _deal(cuts: np.ndarray, least: int):
    """Each row with its range, and a second time where it is the first of the next range."""
    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(there, np.searchsorted(cuts, doc, "right"), -1)
            zero = np.zeros(len(doc), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(zero), ids, b.column("text")],
                                             names=["part", "tail", "doc_id", "text"])
            heads = there & (part > 0) & np.isin(doc, cuts)
            for hit, to in ((heads, part - 1), (there & (doc == least), np.full(len(doc), len(cuts)))):
                if hit.any():
                    some = pa.array(hit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[hit].astype(np.int32)), pa.array(zero[hit] + 1), ids.filter(some), b.column("text").filter(some)],
                        names=["part", "tail", "doc_id", "text"])

    return run


def _pairs(batches):
    """(doc_id, text, next document's text) in order; rows of one range stand together, its tail last."""
    held = None  # (part, doc_id, text) that waits for its next document
    for b in batches:
        for part, tail, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text"))):
            if part < 0:
                yield doc, text, ""
            elif held is not None and held[0] == part:
                yield held[1], held[2], text
                held = None if tail else (part, doc, text)
            elif not tail:
                held = (part, doc, text)


def _likeness(batches):
    def flush(rows):
        near = [t for _, t, _ in rows]
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for _, t, n in rows]
        coded = [t.encode() for t in near]
        other = [e.encode() for e in edited]
        # a row's next document is the next row's own, but at the end and between ranges
        chained = [i + 1 < len(rows) and rows[i + 1][1] is rows[i][2] for i in range(len(rows))]
        last = [rows[i][2].encode() for i in range(len(rows)) if not chained[i]]
        marks = fingerprints(coded + other + last)
        own, edit, rest = marks[:len(rows)], marks[len(rows):2 * len(rows)], iter(marks[2 * len(rows):])
        following = [own[i + 1] if chained[i] else next(rest) for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for t in near], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in other], pa.string()),
            pa.array([written(x) for x in own], pa.string()), pa.array([written(x) for x in edit], pa.string()),
            pa.array([containment(x, y) for x, y in zip(own, edit)], pa.float64()),
            pa.array([containment(x, y) for x, y in zip(own, following)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows, size = [], 0
    for row in _pairs(batches):
        rows.append(row)
        size += len(row[1])
        if size >= SLICE_BYTES // 2:
            yield flush(rows)
            rows, size = [], 0
    if rows:
        yield flush(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = text_rows(docs)
    ranges = 4 * parts
    at = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(10 * ranges)).alias("cuts")).first()
    least = found["least"] if found["least"] is not None else 0
    cuts = np.array(sorted({c for c in found["cuts"] or [] if c > least}), dtype=np.int64)
    return rows.mapInArrow(_deal(cuts, least), "part int, tail int, doc_id long, text string") \
        .repartition(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "text") \
        .mapInArrow(_likeness, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                               "edited_fingerprint string, near_edited double, near_next double")
