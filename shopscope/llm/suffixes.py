"""Removal of every byte inside a repeated 200-byte string, by a distributed merge sort of suffixes.

Sorting every suffix of the corpus would exchange 200 bytes for each byte of text. Only anchored
suffixes are sorted: of the 64-byte strings inside a 200-byte window the one with the least hash
(leftmost at ties) is the window's anchor. Equal windows have their anchors at equal offsets, so a
repeated window shows up among suffixes that start at equal anchors.

1. ``_anchors``: hash and place of each anchor (about one for 69 bytes), exchanged by hash as packed
   arrays; anchors whose hash occurs once are dropped. What repeats inside a task needs no exchange
   beyond one entry with its count.
2. ``_runs``: each task sorts the suffixes at the remaining anchors (only as long as their windows
   need) and sends them as front-coded sorted runs (length of the prefix shared with the suffix
   before, then the rest), each with the bytes to the left of its anchor. Equal contexts within a run
   are sent once; the task itself marks them as repeated.
3. ``_merge``: a loser tree merges the runs. Every entry knows the length of the prefix that it
   shares with the last winner, so two entries are compared from there on and known prefixes are
   never read again; the tree's output is the sorted order with its common-prefix lengths.
4. The windows at offset o of an anchor are equal if their suffixes agree on 200 - o bytes and
   their left contexts on o bytes. Both follow from the common-prefix lengths of the two sorted
   orders, for all records of a task at once, without looking at pairs.
5. The marked intervals return to their documents, which are cut and hashed.

An anchor that is common (``HOT`` times or more) doesn't gather in one task: each of its windows is
sent as a suffix of its own, dealt by the window's content. At most ``HOT_ANCHORS`` anchors are treated
so (their list is broadcast); in corpora of more than HOT * HOT_ANCHORS anchors the limit rises above ``HOT``
accordingly. A task holds one run (``RUN_BYTES``), or the entries of its merge a batch at a time: a batch ends
where the next suffix shares less than an anchor with the last, as no repeated window crosses that.

Results are exact for every pair of equal windows; 64-bit hashes select candidates and name documents
(hash of doc_id and text). Null texts are empty; texts below 200 bytes lose nothing; repeated rows
are copies of each other. Empty input: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.llm.common import mix64, partitions, prefix_hash, span_hash, staged, text_rows, text_slices

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
#: Anchors that occur as often as this are dealt by window, the most frequent HOT_ANCHORS at most.
HOT, HOT_ANCHORS = 4096, 1 << 21
#: Anchors that a task holds before it sends them; bytes of suffixes and left contexts in one sorted run.
FLUSH = 1 << 19
RUN_BYTES = 1 << 25
#: Merged entries that are looked at together, at least (a batch ends between two anchors).
MERGED = 1 << 15
_CHUNK = 1 << 22


def anchors(data: np.ndarray, offs: np.ndarray):
    """For a slice of documents: (position, hash, least offset, greatest offset) of every anchor.

    The anchor covers the windows that start between position - greatest and position - least."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z
    if n > _CHUNK:  # one long document: windows of consecutive stretches
        parts = []
        for i in range(0, n - LENGTH + 1, _CHUNK - LENGTH + 1):
            end = min(n, i + _CHUNK)
            inner = offs[(offs > i) & (offs < end)]
            pos, h, lo, hi = anchors(data[i:end], np.concatenate(([i], inner, [end])) - i)
            parts.append((pos + i, h, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*parts))
    at = np.arange(n - GRAM + 1, dtype=np.int64)
    h = span_hash(prefix_hash(data), at, at + GRAM)
    key = (h >> np.uint64(22) << np.uint64(22)) | at.astype(np.uint64)
    width = REACH + 1
    pad = -len(key) % width
    rows = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - LENGTH + 1
    best = np.minimum(back[:m], ahead[REACH:REACH + m])
    ends = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(np.arange(m) + LENGTH <= ends[:m])
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z
    pos = (best[start] & np.uint64(_CHUNK - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    last = np.concatenate((first[1:], [len(pos)])) - 1
    p = pos[first]
    # anchors have small hashes (the least of many): mixed again they spread over all buckets
    return p, mix64(h[p]), p - start[last], p - start[first]


def _anchors(buckets: int):
    def pack(rows):
        h, doc, pos = (np.concatenate(v) for v in zip(*rows))
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.concatenate((first, [len(h)])))
        known = np.repeat(count > 1, count)
        bucket = (h[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        sure = np.flatnonzero(known)
        sure_bucket = (doc[sure].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(sure_bucket, kind="stable")
        sure, sure_bucket = sure[order], sure_bucket[order]
        key_at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        sure_at = np.searchsorted(sure_bucket, np.arange(buckets + 1, dtype=np.uint64))
        out_b, out = [], []
        for b in range(buckets):
            f, s = first[key_at[b]:key_at[b + 1]], sure[sure_at[b]:sure_at[b + 1]]
            if len(f) or len(s):
                out_b.append(b)
                out.append(np.array([len(f), len(s)], np.int64).tobytes() + h[f].tobytes() + doc[f].tobytes()
                           + doc[s].tobytes() + pos[f].astype(np.int32).tobytes()
                           + count[key_at[b]:key_at[b + 1]].astype(np.int32).tobytes() + pos[s].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            keys = b.column("dk").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in text_slices(b):
                pos, h, _, _ = anchors(data, offs)
                if len(pos):
                    doc = np.searchsorted(offs, pos, "right") - 1
                    rows.append((h, keys[lo:hi][doc], pos - offs[doc]))
                    size += len(pos)
                if size >= FLUSH:
                    yield pack(rows)
                    rows, size = [], 0
        if rows:
            yield pack(rows)

    return run


def _repeated_anchors(batches):
    """kind 0: (document, anchor position) of anchors whose hash occurs again; kind 1: (hash, times) of
    those that occur often; kind 2: (0, number of anchors)."""
    keyed = []
    for b in batches:
        for blob in b.column("blob"):
            raw = np.frombuffer(blob.as_buffer(), dtype=np.uint8)
            nk, ns = (int(x) for x in raw[:16].view(np.int64))
            at, parts = 16, []
            for kind, size in ((np.uint64, nk), (np.int64, nk), (np.int64, ns), (np.int32, nk), (np.int32, nk), (np.int32, ns)):
                parts.append(raw[at:at + size * np.dtype(kind).itemsize].view(kind))
                at += size * np.dtype(kind).itemsize
            h, doc, sure_doc, pos, count, sure_pos = parts
            if ns:
                yield _three(0, sure_doc, sure_pos.astype(np.int64))
            if nk:
                keyed.append((h.copy(), doc.copy(), pos.copy(), count.copy()))
    if not keyed:
        return
    h, doc, pos, count = (np.concatenate(v) for v in zip(*keyed))
    order = np.argsort(h, kind="stable")
    h, doc, pos, count = h[order], doc[order], pos[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    total = np.add.reduceat(count.astype(np.int64), first)
    each = np.repeat(total, np.diff(np.concatenate((first, [len(h)]))))
    single = (each > 1) & (count == 1)
    yield _three(0, doc[single], pos[single].astype(np.int64))
    often = total >= HOT
    yield _three(1, h[first][often].view(np.int64), total[often])
    yield _three(2, np.zeros(1, np.int64), total.sum(keepdims=True))


def _three(kind, a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)],
                                      names=["kind", "a", "b"])


# ---------------------------------------------------------------- sorted runs

def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes], lefts: list[bytes], numbers: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run as one fixed-width head for each record (``numbers`` holds its least and greatest
    offset, document, position and whether it is repeated), and the bytes of suffix rests and left contexts."""
    head = np.zeros(len(suffixes), dtype=_HEAD)
    for name in ("lo", "hi", "multi", "pos", "doc"):
        head[name] = numbers[name]
    body, before = [], b""
    shared = []
    for r, left in zip(suffixes, lefts):
        k = shared_prefix(before, r)
        shared.append(k)
        body += (r[k:], left)
        before = r
    head["shared"], head["left"] = shared, [len(x) for x in lefts]
    head["rest"] = [len(r) - k for r, k in zip(suffixes, shared)]
    return head.tobytes(), b"".join(body)


_HEAD = np.dtype([("shared", "u1"), ("rest", "u1"), ("left", "u1"), ("lo", "u1"), ("hi", "u1"), ("multi", "u1"),
                  ("pos", "<i4"), ("doc", "<i8")])


def read_run(blob: memoryview | bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the record before, suffix, the rest of the record)."""
    n = int.from_bytes(blob[:8], "little")
    head = np.frombuffer(blob, dtype=_HEAD, count=n, offset=8)
    at, before = 8 + n * _HEAD.itemsize, b""
    for k, rest, left, lo, hi, multi, pos, doc in head.tolist():
        before = before[:k] + bytes(blob[at:at + rest])
        at += rest
        yield k, before, (bytes(blob[at:at + left]), lo, hi, multi, pos, doc)
        at += left


def merge_runs(runs: list) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge sorted runs with a loser tree on (common prefix with the last winner, suffix).

    Of two entries, the one that shares more with the last winner is the smaller and the loser's
    length still holds; at equal lengths the strings are compared from that length on. So the order
    and the lengths come out together, and bytes that are known to agree are never compared again."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    share = [0] * k
    tree = [-1] * k  # losers; tree[0] is the winner

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); afterwards the loser's length is the one it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        if share[i] != share[j]:
            return (i, j) if share[i] > share[j] else (j, i)
        x, y = a[1], b[1]
        same = shared_prefix(x, y, share[i])
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            share[j] = same
            return i, j
        share[i] = same
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    tree[0] = build(1) if k > 1 else 0
    while heads[w := tree[0]] is not None:
        yield share[w], heads[w][1], heads[w][2]
        heads[w] = next(runs[w], None)
        share[w] = heads[w][0] if heads[w] is not None else 0
        node = (w + k) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2
        tree[0] = w


_NUMBERS = np.dtype([("bucket", "<i4"), ("lo", "u1"), ("hi", "u1"), ("multi", "u1"), ("pos", "<i4"), ("doc", "<i8")])


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The union of marked intervals as disjoint ones, ordered by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    row = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(row * np.int64(far) + end) - row * np.int64(far)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))))
    last = np.concatenate((new[1:], [len(doc)])) - 1
    return doc[new], start[new], reach[last]


class _Run:
    """Records of a run: bytes in lists, numbers in arrays."""

    def __init__(self):
        self.suffixes, self.lefts, self.numbers, self.size = [], [], [], 0

    def add(self, suffixes, lefts, bucket, lo, hi, pos, doc):
        n = np.zeros(len(suffixes), dtype=_NUMBERS)
        n["bucket"], n["lo"], n["hi"], n["pos"], n["doc"] = bucket, lo, hi, pos, doc
        self.suffixes += suffixes
        self.lefts += lefts
        self.numbers.append(n)
        self.size += sum(map(len, suffixes)) + sum(map(len, lefts))

    def flush(self, buckets: int):
        """One blob for each bucket; what repeats inside the run is marked at once, joined by document."""
        numbers = np.concatenate(self.numbers)
        bucket, lo, hi = (numbers[c].tolist() for c in ("bucket", "lo", "hi"))
        r, left = self.suffixes, self.lefts
        order = sorted(range(len(r)), key=lambda i: (bucket[i], r[i], left[i], lo[i], hi[i]))
        same = np.array([(bucket[i], r[i], left[i], lo[i], hi[i]) == (bucket[j], r[j], left[j], lo[j], hi[j])
                         for i, j in zip(order, order[1:])], dtype=bool)
        order = np.array(order, dtype=np.int64)
        first = np.concatenate(([True], ~same))
        size = np.diff(np.concatenate((np.flatnonzero(first), [len(order)])))
        repeated = numbers[order[np.repeat(size > 1, size)]]
        kept = order[first]
        numbers = numbers[kept]
        numbers["multi"] = size > 1
        edge = np.searchsorted(numbers["bucket"], np.arange(buckets + 1))
        out_b, out = [], []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            at = kept[edge[b]:edge[b + 1]].tolist()
            out_b.append(b)
            out.append(len(at).to_bytes(8, "little") + b"".join(
                front_coded([r[i] for i in at], [left[i] for i in at], numbers[edge[b]:edge[b + 1]])))
        self.__init__()
        none = pa.nulls(len(out), pa.int64())
        yield _mixed(pa.array(out_b, pa.int32()), pa.array(out, pa.binary()), none, none, none)
        pos = repeated["pos"].astype(np.int64)
        doc, s, e = _joined(repeated["doc"].astype(np.int64), pos - repeated["hi"], pos - repeated["lo"] + LENGTH)
        if len(doc):
            # marked intervals are spread over all tasks by their document
            yield _mixed(pa.array((doc % buckets).astype(np.int32)), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(s), pa.array(e))


def _runs(hot, buckets: int):
    """Sorted runs of each task."""
    def bucket_of(h):
        return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)

    def run(batches):
        common = hot.value
        held = _Run()
        for b in batches:
            keys = b.column("dk").to_numpy(zero_copy_only=False)
            wanted = b.column("pos")
            for lo, hi, data, offs in text_slices(b):
                pos, h, o_lo, o_hi = anchors(data, offs)
                if not len(pos):
                    continue
                doc = np.searchsorted(offs, pos, "right") - 1
                want = [wanted[lo + i].values.to_numpy(zero_copy_only=False) + offs[i] for i in range(hi - lo)]
                keep = np.isin(pos, np.concatenate(want))
                pos, h, o_lo, o_hi, doc = (x[keep] for x in (pos, h, o_lo, o_hi, doc))
                raw = data.tobytes()
                begin, dk = offs[doc], keys[lo:hi][doc]
                at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                often = common[at] == h if len(common) else np.zeros(len(h), bool)
                for i in range(0, len(pos), 1 << 14):
                    g = np.flatnonzero(~often[i:i + (1 << 14)]) + i
                    p, a, z = pos[g].tolist(), o_lo[g].tolist(), o_hi[g].tolist()
                    held.add([raw[x:x - y + LENGTH] for x, y in zip(p, a)], [raw[x - y:x][::-1] for x, y in zip(p, z)],
                             bucket_of(h[g]), o_lo[g], o_hi[g], pos[g] - begin[g], dk[g])
                    if held.size >= RUN_BYTES:
                        yield from held.flush(buckets)
                dense = np.flatnonzero(often)
                if len(dense):
                    prefix = prefix_hash(data)
                    for g in dense.tolist():
                        first = np.arange(pos[g] - o_hi[g], pos[g] - o_lo[g] + 1)
                        content = span_hash(prefix, first, first + LENGTH)
                        held.add([raw[x:x + LENGTH] for x in first.tolist()], [b""] * len(first), bucket_of(content), 0, 0,
                                 first - begin[g], dk[g])
                        if held.size >= RUN_BYTES:
                            yield from held.flush(buckets)
        if held.suffixes:
            yield from held.flush(buckets)

    return run


_MIXED = "bucket int, blob binary, dk long, s long, e long"


def _mixed(*columns):
    return pa.RecordBatch.from_arrays(list(columns), names=["bucket", "blob", "dk", "s", "e"])


def repeated_offsets(share: np.ndarray, left: list[bytes], lo: np.ndarray, hi: np.ndarray,
                     multi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of a repeated window of each record (-1: none).

    ``share``: common prefix of each suffix with the one before, in sorted order."""
    n = len(left)
    size = np.fromiter((len(x) for x in left), np.int64, n)
    by_left = np.array(sorted(range(n), key=left.__getitem__), dtype=np.int64)
    width = max(1, int(size.max(initial=0)))
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in left), dtype=np.uint8).reshape(n, width)[by_left]
    differ = grid[1:] != grid[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if n > 1 else np.zeros(0, np.int64)
    s = size[by_left]
    left_share = np.concatenate(([0], np.minimum(common, np.minimum(s[1:], s[:-1]))))
    least, most = np.full(n, -1), np.full(n, -1)
    least[multi], most[multi] = lo[multi], hi[multi]
    rank = np.empty(n, np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        at = np.flatnonzero((lo <= o) & (hi >= o))
        if len(at) < 2:
            continue
        right = np.cumsum(share < LENGTH - o)[at]
        rank[by_left] = np.cumsum(left_share < o)
        key = right * np.int64(n + 1) + rank[at]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[hit] = np.where(least[hit] < 0, o, np.minimum(least[hit], o))
        most[hit] = np.maximum(most[hit], o)
    return least, most


def _marked(share, left, rest):
    lo, hi, multi, pos, doc = (np.array(x, dtype=np.int64) for x in zip(*rest))
    least, most = repeated_offsets(np.array(share), left, lo, hi, multi > 0)
    hit = (least >= 0) & (multi == 0)  # the others are marked already
    doc, s, e = _joined(doc[hit], pos[hit] - most[hit], pos[hit] - least[hit] + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s), pa.array(e)], names=["dk", "s", "e"])


def _merge(batches):
    blobs = []
    for b in batches:
        done = b.column("dk").is_valid()
        if pa.compute.any(done).as_py():
            yield b.filter(done).select(["dk", "s", "e"])
        blobs += [x.as_buffer().to_pybytes() for x in b.column("blob") if x.is_valid]
    share, left, rest = [], [], []
    for k, _, (l, *more) in merge_runs([read_run(x) for x in blobs]):
        if len(share) >= MERGED and k < GRAM:
            yield _marked(share, left, rest)
            share, left, rest = [], [], []
        share.append(k)
        left.append(l)
        rest.append(more)
    if share:
        yield _marked(share, left, rest)


def _cut(batches):
    for b in batches:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        texts, ids, spans = b.column("text"), b.column("doc_id"), b.column("spans")
        for i in range(b.num_rows):
            text = texts[i].as_buffer()
            text = text.to_pybytes() if text is not None else b""
            merged: list[list[int]] = []
            if spans[i].is_valid:
                for x in sorted((x["s"], x["e"]) for x in spans[i].as_py()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
            at, kept = 0, []
            for s, e in merged:
                kept.append(text[at:s])
                at = e
            kept = b"".join((*kept, text[at:]))
            for k, v in zip(out, (ids[i].as_py(), len(text), len(text) - len(kept), len(merged),
                                  hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
            names=list(out))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): the documents without repeated bytes.

    ``kept`` holds the remaining bytes (a cut may fall inside a character)."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = text_rows(docs).withColumn("dk", F.xxhash64("doc_id", "text"))
    found = rows.select("dk", "text").where(F.octet_length("text") >= LENGTH) \
        .mapInArrow(_anchors(buckets), "bucket int, blob binary") \
        .repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated_anchors, "kind byte, a long, b long")
    found = staged(found, "suffix-anchors")
    total = found.where("kind = 2").agg(F.sum("b")).first()[0] or 0
    least = max(HOT, total // HOT_ANCHORS)  # fewer than HOT_ANCHORS anchors occur as often
    often = found.where((F.col("kind") == 1) & (F.col("b") >= least)).select("a").toArrow()["a"].to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    places = found.where("kind = 0").groupBy(F.col("a").alias("dk")).agg(F.collect_set("b").alias("pos"))
    spans = rows.select("dk", "text").join(places, "dk").mapInArrow(_runs(hot, buckets), _MIXED) \
        .repartitionById(buckets, F.col("bucket")).mapInArrow(_merge, "dk long, s long, e long")
    spans = spans.groupBy("dk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return rows.join(spans, "dk", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans") \
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
