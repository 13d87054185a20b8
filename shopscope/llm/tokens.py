"""Token ids as binary files with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by doc_id, encoded, and packed into blocks of about
``BLOCK_IDS`` ids. A block is one row of a Parquet table in the shared folder (so a lost task leaves
nothing behind): its task's number and place, its documents' ids, and a payload

    "EFT1", bytes for each id (2 or 4), number of documents, of ids, low bits, length of the high bits,
    number of select samples | low bits | high bits | select samples | ids, little-endian

The boundaries (running numbers of ids) are monotone, so Elias-Fano stores each with its low bits as
they are and its high bits in unary: about 2 + log2(ids / documents) bits. The samples hold the
position of every 64th one of the high bits; ``EliasFano.select`` reads any boundary from there, and
``select_many``, by which the files are read, many of them.

Encoding is done once for each distinct word of a worker. White space never reaches a token, so words
(ASCII white space apart) are encoded by themselves. Words of plain letters, digits and marks are
split as the tokenizer's own pattern does, and its model encodes each part once; all other words go
through the whole tokenizer. A new word of one part, marks behind it aside, needs no pattern.

Null texts are empty: only the end id. Rows with the same id follow each other, ordered by text; null
ids come first. Empty input: no blocks, empty result.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopscope.llm.common import partitions, shared_folder, text_rows

END_ID = 2
BLOCK_IDS = 1 << 20
CACHED_WORDS = 1 << 18
CACHED_PARTS = 1 << 19
SAMPLE_EVERY = 64
_HEAD = struct.Struct("<4sIQQIQQ")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Ones of each byte, and the place of its n-th one.
_ONES = _BITS.sum(axis=1).astype(np.int64)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable")


# ---------------------------------------------------------------- boundaries

class EliasFano:
    """A monotone sequence of integers in [0, last]."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        k = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, k, low, np.packbits(high, bitorder="little"), at[::SAMPLE_EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample of the high bits."""
        at = int(self.samples[i // SAMPLE_EVERY])
        left = i % SAMPLE_EVERY
        while left:
            at += 1
            left -= int(self.high[at >> 3]) >> (at & 7) & 1
        bit = i * self.low_bits
        low = int.from_bytes(self.low[bit >> 3:(bit + self.low_bits + 7 >> 3)].tobytes(), "little") >> (bit & 7)
        return (at - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The i-th values, all walked at once byte by byte from their nearest samples."""
        if not len(i):
            return np.zeros(0, np.int64)
        sample = self.samples[i // SAMPLE_EVERY].astype(np.int64)
        byte, left = sample >> 3, i % SAMPLE_EVERY
        # bits of the first byte up to the sample's own one don't count
        first = self.high[byte] & (0xFE << (sample & 7) & 0xFF).astype(np.uint8)
        seen = np.where(left > 0, first, 0).astype(np.uint8)
        go = np.flatnonzero(left > _ONES[seen])
        while len(go):
            left[go] -= _ONES[seen[go]]
            byte[go] += 1
            seen[go] = self.high[byte[go]]
            go = go[left[go] > _ONES[seen[go]]]
        at = np.where(left > 0, (byte << 3) + _NTH[seen, np.maximum(left, 1) - 1], sample)
        out = (at - i) << self.low_bits
        if self.low_bits:
            # nine bytes from the first one hold a value's low bits
            low = np.concatenate((self.low, np.zeros(9, np.uint8)))
            bit = i * self.low_bits
            bits = np.zeros(len(i), np.uint64)
            for j in range(8):
                bits |= low[(bit >> 3) + j].astype(np.uint64) << np.uint64(8 * j)
            shift = (bit & 7).astype(np.uint64)
            bits >>= shift
            over = shift + np.uint64(self.low_bits) > 64
            bits[over] |= low[(bit[over] >> 3) + 8].astype(np.uint64) << (np.uint64(64) - shift[over])
            out |= (bits & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out

    def values(self) -> np.ndarray:
        """All values at once."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        out = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


def write_block(lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """Payload of documents with these numbers of ids, given one after the other in ``ids``."""
    ef = EliasFano.of(np.cumsum(lengths))
    head = _HEAD.pack(b"EFT1", width, ef.n, len(ids) // width, ef.low_bits, len(ef.high), len(ef.samples))
    return b"".join((head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids))


def read_block(payload) -> tuple[EliasFano, np.ndarray]:
    """(ends of the documents, ids) of a payload."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    magic, width, n, n_ids, k, high, samples = _HEAD.unpack(raw[:_HEAD.size].tobytes())
    if magic != b"EFT1":
        raise ValueError("not a block of token ids")
    at = [_HEAD.size]
    for size in ((n * k + 7) // 8, high, 4 * samples, width * n_ids):
        at.append(at[-1] + size)
    part = [raw[i:j] for i, j in zip(at, at[1:])]
    return (EliasFano(n, k, part[0], part[1], np.frombuffer(part[2].tobytes(), "<u4")),
            np.frombuffer(part[3].tobytes(), f"<u{width}"))


# ---------------------------------------------------------------- encoding

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[!-&(-~{_LETTER}]+")
_PARTS = re.compile(f"[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'")


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Word (bytes) -> its ids as little-endian bytes, encoded when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.names, self.parts = _byte_names(), {}
        self.packed = [self._bytes([i]) for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        low = word.lower()
        head = low.rstrip(_MARKS)
        out = self.parts.get(head) or (self._part(head) if head.isalpha() else None)
        if out is not None and len(head) < len(low):
            tail = low[len(head):]
            marks = self.parts.get(tail) or (self._part(tail) if b"<|" not in tail else None)
            out = None if marks is None else out + marks
        if out is None:
            out = self._split(word.decode("utf-8", "replace"))
        self[word] = out
        return out

    def _split(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.parts.get(p) or self._part(p) for p in map(str.encode, _PARTS.findall(text.lower()))])
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: bytes) -> bytes:
        if len(self.parts) >= CACHED_PARTS:
            self.parts.clear()
        named = part.decode("latin-1")
        if not part.isascii():
            named = named.translate(self.names)
        out = self.parts[part] = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(named)])
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)


_WORDS: dict[str, Words] = {}


def _encode(path: str):
    def run(batches):
        if path not in _WORDS:
            _WORDS[path] = Words(path)
        words = _WORDS[path]
        end = words._bytes([END_ID])
        task, place, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, size = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([place], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([write_block(np.array(lengths), b"".join(parts), words.width)], pa.binary())],
                names=["task", "place", "before", "n_ids", "doc_ids", "payload"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = b"".join(map(words.__getitem__, text.as_buffer().to_pybytes().split())) + end
                docs.append(doc)
                parts.append(ids)
                lengths.append(len(ids) // words.width)
                size += lengths[-1]
                if size >= BLOCK_IDS:
                    yield block()
                    place, before = place + 1, before + size
                    docs, lengths, parts, size = [], [], [], 0
        if docs:
            yield block()

    return run


_BLOCK = "task int, place int, before long, n_ids long, doc_ids array<long>, payload binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> str:
    """Encode all documents in ascending doc_id order into ``folder`` (default: a new shared one)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    text_rows(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(_encode(tokenizer_path), _BLOCK).write.parquet(folder)
    return folder


def _decode(first: dict[int, int]):
    def run(batches):
        for b in batches:
            for task, before, docs, payload in zip(*(b.column(c) for c in ("task", "before", "doc_ids", "payload"))):
                ends, ids = read_block(payload.as_buffer())
                end = ends.select_many(np.arange(ends.n))
                start = np.concatenate(([0], end[:-1]))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start + first[task.as_py()] + before.as_py()), pa.array(end - start),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    # one row for each writing task
    first, at = {}, 0
    for r in sorted(blocks.groupBy("task").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["task"]):
        first[r["task"]] = at
        at += r["n"]
    return blocks.select("task", "before", "doc_ids", "payload") \
        .mapInArrow(_decode(first), "doc_id long, start long, n_tokens long, ids_crc32 long")
