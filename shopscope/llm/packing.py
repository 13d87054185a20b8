"""Best-fit packing into bins of several permitted capacities.

Sizes are words; a text longer than the greatest capacity is cut into pieces of that size and a rest.
Pieces are taken from long to short. Each goes to the open bin with the least space that holds it;
without one, a bin is opened whose capacity costs least for each word that it would then hold (the
piece, as many equals as fit, and a greedy fill from the sizes still to come; a bin costs its
capacity and ``OVERHEAD``). At the end every bin shrinks to the least capacity that holds its contents.

Only sizes matter to this, and there are at most max(capacities) of them. So the driver packs the
histogram (one count for each size): equal pieces are placed on ranges of equal bins at once, and the
result is a table of placements (size, ranks) -> (bins, offset). Each piece finds its place by its
rank among the pieces of its size; ranks are counted in ``SLICES`` slices of each size, so a size that
a third of all pieces have isn't sorted in one task.

Null or wordless text: one row without a bin. Repeated rows are packed each for itself; their order is
by doc_id, start and the text's hash. Empty input: empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopscope.llm.common import WORD_PATTERN, partitions, ship_package, staged

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
SLICES = 256


def _estimated_fill(space: int, below: list[int], left: dict[int, int]) -> int:
    """Words that a greedy fill (greatest size first) puts into ``space``; ``below``: ascending sizes."""
    used, hi = 0, len(below)
    while space > used and (i := bisect.bisect_right(below, space - used, 0, hi)):
        s = below[i - 1]
        used += s * min(left[s], (space - used) // s)
        hi = i - 1
    return used


def plan(histogram: dict[int, int], capacities=CAPACITIES, overhead: int = OVERHEAD):
    """Placements [size, first rank, pieces, first bin, offset, pieces in each bin] and bins
    [first bin, bins, capacity, words in each], both sorted."""
    capacities = sorted(capacities)
    left = {s: c for s, c in histogram.items() if s > 0 and c > 0}
    ascending = sorted(left)
    spaces: list[int] = []  # ascending, of open bins
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # space -> [(first bin, bins, used)]
    closed: list[tuple[int, int, int]] = []
    placements: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0
    smallest = ascending[0] if ascending else 0

    def put_back(first: int, bins: int, used: int, space: int) -> None:
        if space < smallest:
            closed.append((first, bins, used))
            return
        if space not in open_bins:
            bisect.insort(spaces, space)
            open_bins[space] = []
        open_bins[space].append((first, bins, used))

    def fill(first: int, bins: int, used: int, space: int, s: int, rank: int, count: int) -> int:
        """Fill equal bins, one after the other, with pieces of size s; the number placed."""
        each = space // s
        full = min(bins, count // each)
        if full:
            placements.append((s, rank, full * each, first, used, each))
            put_back(first, full, used + each * s, space - each * s)
        rest = min(count - full * each, each) if full < bins else 0
        if rest:
            placements.append((s, rank + full * each, rest, first + full, used, each))
            put_back(first + full, 1, used + rest * s, space - rest * s)
        untouched = bins - full - (rest > 0)
        if untouched:
            put_back(first + bins - untouched, untouched, used, space)
        return full * each + rest

    for at in range(len(ascending) - 1, -1, -1):
        s = ascending[at]
        count, rank = left[s], 0
        while rank < count:
            i = bisect.bisect_left(spaces, s)
            if i < len(spaces):
                space = spaces[i]
                first, bins, used = open_bins[space].pop()
                if not open_bins[space]:
                    del open_bins[space], spaces[i]
                rank += fill(first, bins, used, space, s, rank, count - rank)
                continue
            need = count - rank
            below = ascending[:at]

            def cost(c: int) -> float:
                own = min(need, c // s) * s
                return (c + overhead) / (own + _estimated_fill(c - own, below, left))

            best = min((c for c in capacities if c >= s), key=lambda c: (cost(c), -c))
            bins = max(1, need // (best // s))
            rank += fill(next_bin, bins, 0, best, s, rank, need)
            next_bin += bins
    for group in open_bins.values():
        closed += group
    bins = sorted((f, n, capacities[bisect.bisect_left(capacities, u)], u) for f, n, u in closed)
    return sorted(placements), bins


def _placed(tables):
    def run(batches):
        p, b = tables.value
        for x in batches:
            size, rank = x.column("length").to_numpy(), x.column("rank").to_numpy()
            real = size > 0
            bin_id, offset, capacity = (np.zeros(len(size), np.int64) for _ in range(3))
            if real.any():
                # sizes are below 2**20, ranks below 2**43
                at = np.searchsorted(p[:, 0] << 43 | p[:, 1], size[real] << 43 | rank[real], "right") - 1
                k = rank[real] - p[at, 1]
                bin_id[real] = p[at, 3] + k // p[at, 5]
                offset[real] = p[at, 4] + k % p[at, 5] * size[real]
                capacity[real] = b[np.searchsorted(b[:, 0], bin_id[real], "right") - 1, 2]
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id"), x.column("start"), x.column("length"),
                 *[pa.array(v, mask=~real) for v in (bin_id, offset, capacity)]],
                names=["doc_id", "start", "length", "bin_id", "bin_offset", "bin_capacity"])

    return run


def pack(docs: DataFrame, capacities=CAPACITIES) -> DataFrame:
    """(doc_id, start, length, bin_id, bin_offset, bin_capacity) of every piece; all in words."""
    spark = docs.sparkSession
    ship_package(spark)
    greatest = max(capacities)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
                        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"))
    starts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(greatest).cast("long"))) \
        .otherwise(F.array(F.lit(0).cast("long")))
    pieces = sized.select("doc_id", "tie", "size", F.explode(starts).alias("start")) \
        .withColumn("length", F.least(F.lit(greatest).cast("long"), F.col("size") - F.col("start"))) \
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(SLICES, partitions(spark)))).cast("int")).drop("size")
    pieces = staged(pieces, "pack-pieces")
    counts = staged(pieces.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements, bins = plan(histogram, capacities)
    tables = spark.sparkContext.broadcast((np.array(placements, dtype=np.int64).reshape(-1, 6),
                                           np.array(bins, dtype=np.int64).reshape(-1, 4)))
    ahead = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("length", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "tie")
    ranked = pieces.join(begin, ["length", "slice"]) \
        .select("doc_id", "start", "length", (F.col("begin") + F.row_number().over(within) - 1).alias("rank"))
    return ranked.mapInArrow(_placed(tables), "doc_id long, start long, length long, bin_id long, bin_offset long, bin_capacity long")
