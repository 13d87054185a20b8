"""Helpers shared by the operators: input columns, shared folders, byte-level word hashing,
connected components.

Every operator reads its input by column name (``doc_id``, ``text`` and what it needs besides),
so further columns, whatever they are called, never reach it.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopscope.session import ensure_checkpoint_dir, scratch_dir

#: Bytes of text that numpy works on at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 17
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once for each application)."""
    sc = spark.sparkContext
    if getattr(sc, "_shopscope_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="shopscope-")) / "shopscope.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._shopscope_shipped = True


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id long, text string, *more); a null text becomes the empty one."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name in the cluster's shared checkpoint directory.

    Only a local master without that setting gets a scratch folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = ensure_checkpoint_dir(spark, fallback=scratch_dir("shopscope-llm-"))
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of an ended execution go at once, not when the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables staged in this block, but for those with ``keep``, are deleted at its end.

    What leaves the block must rest on kept tables alone; then a lost executor's work is repeated from those."""
    paths: list[str] = []
    outer = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(outer)
        for p in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One of Spark's own settings for the queries that run in this block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def staged(df: DataFrame, tag: str, keep: bool = False, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at those files, and the shuffle
    files of the write, which nothing reads again, are dropped when it has ended. See ``passing_tables`` for ``keep``.

    ``batch_bytes``: about the most that one Arrow batch of the write holds, in the executor and in its Python worker."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    if not keep and (passing := _PASSING.get()) is not None:
        passing.append(path)
    with contextlib.ExitStack() as own:
        own.enter_context(setting(spark, _DROP_SHUFFLES, "true"))
        if batch_bytes:
            own.enter_context(setting(spark, _BATCH_BYTES, str(batch_bytes)))
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of one row of ``bitmap_construct_agg``; most of them that are broadcast (16 MB).
_ROW_BITS, MAX_BITS = 1 << 15, 1 << 27


def bitmap(keys: DataFrame, column: str, rows: int, keep: bool = False) -> tuple[DataFrame, int]:
    """A table of the hashed values of a column, about 16 bits a row but ``MAX_BITS`` at most, and its number of bits."""
    bits = min(max(_ROW_BITS, 1 << (16 * rows).bit_length()), MAX_BITS)
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    marks = keys.groupBy(F.floor(at / _ROW_BITS).cast("long").alias("__row")) \
        .agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_ROW_BITS))).alias("__marks"))
    return staged(marks, "bitmap", keep=keep), bits


def marked(rows: DataFrame, column: str, marks: tuple[DataFrame, int], there: bool = True) -> DataFrame:
    """The rows whose value may be in the bitmap (some others pass as well), or, not ``there``, those whose value isn't.

    A broadcast of bounded size takes the place of an exchange of all rows; an exact join of what is left follows."""
    table, bits = marks
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    place = F.pmod(at, F.lit(_ROW_BITS))
    byte = F.conv(F.hex(F.expr("substring(__marks, __byte + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumns({"__row": F.floor(at / _ROW_BITS).cast("long"), "__byte": F.floor(place / 8).cast("int"),
                              "__bit": F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")}) \
        .join(F.broadcast(table), "__row", "inner" if there else "left")
    hit = F.coalesce(byte.bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return found.where(hit if there else ~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def tidy(run):
    """A task's function that gives freed memory back when its batches are done: workers live on and
    serve the next stages, which count what an earlier one left."""
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
            ctypes.CDLL(None).malloc_trim(0)

    return task


# ---------------------------------------------------------------- text as bytes

def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes together."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    n = len(arr)
    if not n:
        return
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[arr.offset:arr.offset + n + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**position, modulo 2**64."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal spans have equal hashes."""
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start]
                 + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word (run of bytes outside ``space``) in a slice."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 0x41) & (data <= 0x5A)
    return data | (up.astype(np.uint8) << np.uint8(5))


_MULT = [np.uint64(m) for m in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def window_hashes(word_hash: np.ndarray, word_doc: np.ndarray, k: int = 5):
    """Hash of every window of ``k`` words inside one document: (hash, index of first word)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = word_hash[:n] * _MULT[0]
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) + word_hash[j:n + j] * _MULT[j % len(_MULT)]
    first = np.flatnonzero(word_doc[:n] == word_doc[k - 1:])
    return mix64(acc[first]), first


# ---------------------------------------------------------------- graphs

def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, comp): the smallest node of each connected component, for all nodes with an edge.

    ``edges`` has the columns a, b. Large-star and small-star rounds (each a grouping with
    map-side combine and a join that adaptive execution splits at hot nodes) until the set of
    edges stays the same; every round ends in a table in the shared folder. Nothing but a count
    and a checksum reaches the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, tag)
    last = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        last = tuple(mark)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")) \
            .select("x.a", "x.b").where("a <> b").distinct()
        e = staged(small, tag)
