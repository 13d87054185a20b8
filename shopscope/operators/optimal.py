"""The exact optimum of one-dimensional k-means on a (value, weight) histogram of any size.

In one dimension clusters are ranges of values, so a clustering is its k - 1 borders, and dynamic
programming over prefix sums finds the best ones. Sorting all distinct values into one task isn't needed
for that: values are summed in ``cells`` (ranges of values; weight, sum and sum of squares each), and
only the few thousand cell sums reach the driver.

* Upper bound: the best clustering whose borders lie between cells.
* Lower bound of every clustering with border j inside a given cell: the same programme, in which the
  clusters on both sides of that border leave the cell out (leaving values out never raises the sum of
  squares).
* Cells whose lower bound exceeds the upper bound hold no border and are closed for good; borders
  between cells that are excluded the same way are dropped. Stretches of the other cells are divided anew
  by one more aggregation over their values alone, until every cell that may hold a border is a single
  value. Then the upper bound is the exact optimum.

The objective is flat near the optimum, so about the square root of the number of distinct values stays
possible per border. Costs satisfy the quadrangle inequality, so each level of the programme takes
n log n steps. All series and all k are refined by the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopscope.functions import bucket_by_edges

CELLS = 2048
#: A round makes the widest cell of a stretch this much narrower at least.
FINER = 4
#: Stretches of one series that are divided anew at once; neighbours join beyond that.
STRETCHES = 64
#: Relative slack of the bounds against rounding in the sums of squares.
SLACK = 1e-11


class _Cells:
    """Cells of one series in ascending order: extreme values, sums about a shift, and whether a border
    may lie inside (as far as is known)."""

    def __init__(self, lo, hi, w, s, q, open_=None):
        self.columns = [lo, hi, w, s, q, lo < hi if open_ is None else open_]
        self.lo, self.hi, self.w, self.s, self.q, self.open = self.columns

    def __len__(self):
        return len(self.lo)

    def sums(self):
        return tuple(np.concatenate(([0.0], np.cumsum(x))) for x in (self.w, self.s, self.q))

    def replaced(self, runs: list[tuple[int, int]], new: dict, keep_edge: np.ndarray) -> "_Cells":
        """Runs (first, end) of cells give way to new cells; between them, cells are closed and become
        one where the edge between them isn't kept."""
        parts, at = [], 0
        for r, (first, end) in enumerate([*runs, (len(self), len(self))]):
            if at < first:
                head = np.flatnonzero(np.concatenate(([True], keep_edge[at:first - 1]))) + at
                last = np.concatenate((head[1:], [first])) - 1
                sums = [np.add.reduceat(x[:first], head) for x in (self.w, self.s, self.q)]
                parts.append([self.lo[head], self.hi[last], *sums, np.zeros(len(head), bool)])
            if first < end:
                parts.append(new[r].columns)
            at = end
        return _Cells(*(np.concatenate(x) for x in zip(*parts)))


def _cost(sums, a, b):
    """Sum of squares of cells a .. b - 1 about their mean; 0 for none."""
    w, s, q = sums
    weight = w[b] - w[a]
    some = (b > a) & (weight > 0)
    mean_part = np.divide((s[b] - s[a]) ** 2, weight, out=np.zeros_like(weight), where=some)
    return np.where(some, np.maximum(q[b] - q[a] - mean_part, 0.0), 0.0)


def _level(before: np.ndarray, sums, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best[p] = min over o < p of before[o] + cost(start[o], stop[p]) and the least such o.

    Divide and conquer on the monotone choice, all positions of a depth at once."""
    n = len(before)
    best, choice = np.full(n, np.inf), np.zeros(n, np.int64)
    lo, hi = np.array([1]), np.array([n - 1])          # ranges of positions still to solve
    o_lo, o_hi = np.array([0]), np.array([n - 1])      # and of the choices they can take
    while len(lo):
        mid = (lo + hi) >> 1
        top = np.minimum(o_hi, mid - 1)
        size = top - o_lo + 1
        begin = np.cumsum(size) - size
        o = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(o_lo, size)
        p = np.repeat(mid, size)
        value = before[o] + _cost(sums, start[o], stop[p])
        least = np.minimum.reduceat(value, begin)
        at = np.flatnonzero(value == np.repeat(least, size))
        which = np.repeat(np.arange(len(mid)), size)[at]
        pick = o[at[np.concatenate(([True], which[1:] != which[:-1]))]]
        best[mid], choice[mid] = least, pick
        left, right = lo < mid, mid < hi
        lo, hi, o_lo, o_hi = (np.concatenate(x) for x in (
            (lo[left], mid[right] + 1), (mid[left] - 1, hi[right]),
            (o_lo[left], pick[right]), (pick[left], o_hi[right])))
    return best, choice


def _programme(sums, start, stop, k: int):
    """Levels 1 .. k over positions in order (the first is the beginning, the last the end): costs of
    the best clusterings of what lies before each position into that many ranges, and the choices."""
    n = len(start)
    cost = _cost(sums, np.zeros(n, np.int64) + start[0], stop)
    cost[0] = np.inf
    levels, choices = [cost], [np.zeros(n, np.int64)]
    for _ in range(1, k):
        best, choice = _level(levels[-1], sums, start, stop)
        levels.append(best)
        choices.append(choice)
    return levels, choices


def _borders(choices, k: int, end: int) -> list[int]:
    out = [end]
    for j in range(k - 1, 0, -1):
        out.append(int(choices[j][out[-1]]))
    return [0, *out[::-1]]


def _bounds(cells: _Cells, ks: Sequence[int], least: dict):
    """(best edges for each k, mask of cells that may hold a border inside, mask of inner edges to keep).

    ``least``: the least cost known for each k, updated here."""
    m = len(cells)
    sums = cells.sums()
    edges = np.arange(m + 1)
    top = max(ks)
    levels, choices = _programme(sums, edges, edges, top)
    found = {k: _borders(choices, k, m) for k in ks if np.isfinite(levels[k - 1][m])}
    wide = cells.open
    # positions: the edge before each cell, then its inside if it holds several values; at last the end
    cell = np.repeat(np.arange(m), 1 + wide)
    inside = np.zeros(len(cell), dtype=bool)
    inside[np.flatnonzero(np.concatenate(([False], cell[1:] == cell[:-1])))] = True
    start = np.concatenate((np.where(inside, cell + 1, cell), [m]))
    stop = np.concatenate((cell, [m]))
    ahead, _ = _programme(sums, start, stop, top)
    # the same from the other end: mirrored cells
    back_sums = tuple(np.concatenate(([0.0], np.cumsum(x[::-1]))) for x in (cells.w, cells.s, cells.q))
    back, _ = _programme(back_sums, (m - stop)[::-1], (m - start)[::-1], top)
    back = [x[::-1] for x in back]
    whole = _cost(sums, np.array([0]), np.array([m]))[0]
    possible = np.zeros(len(start), dtype=bool)
    for k in ks:
        least[k] = min(least.get(k, np.inf), levels[k - 1][m])
        limit = least[k] + SLACK * whole
        for j in range(1, k):
            possible |= ahead[j - 1] + back[k - j - 1] <= limit
    may_split = np.zeros(m, dtype=bool)
    may_split[cell[inside]] = possible[:-1][inside]
    at_edge = possible[:-1][~inside]  # the edge before each cell
    for borders in found.values():
        at_edge[borders[1:-1]] = True
    return found, may_split, at_edge[1:]


def _range_expr(value: Column, ranges: list[tuple[float, float, int]]) -> Column:
    """Struct (range, cell) of a value, null outside all ranges (ascending, disjoint)."""
    i = bucket_by_edges(value, [hi for _, hi, _ in ranges])

    def of_range(numbers):
        return F.get(F.array(*[F.lit(x) for x in numbers]), i)

    lo, parts = of_range([r[0] for r in ranges]), of_range([r[2] for r in ranges])
    width = of_range([(r[1] - r[0]) / r[2] for r in ranges])
    cell = F.when(width > 0, F.least(F.floor((value - lo) / width), parts - 1)).otherwise(F.lit(0)).cast("long")
    return F.when(value >= lo, F.struct(i.cast("int").alias("r"), cell.alias("c")))


def _summed(hist: DataFrame, series_col: str, ranges: dict, shifts: dict) -> dict:
    """series -> {range: _Cells}: one aggregation over the values inside the ranges."""
    v = F.col("value")
    spot = shift = None
    for s, r in ranges.items():
        mine = F.col(series_col).eqNullSafe(F.lit(s))
        e, m = _range_expr(v, r), F.lit(float(shifts[s]))
        spot = F.when(mine, e) if spot is None else spot.when(mine, e)
        shift = F.when(mine, m) if shift is None else shift.when(mine, m)
    d = v - F.col("m")
    rows = hist.select(F.col(series_col).alias("s"), "value", "weight", spot.alias("at"), shift.alias("m")) \
        .where(F.col("at").isNotNull()).groupBy("s", "at.r", "at.c") \
        .agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum("weight").alias("w"),
             F.sum(F.col("weight") * d).alias("sx"), F.sum(F.col("weight") * d * d).alias("sq")).collect()
    out: dict = {s: {} for s in ranges}
    for row in sorted(rows, key=lambda x: (x["r"], x["c"])):
        out[row["s"]].setdefault(row["r"], []).append((row["lo"], row["hi"], row["w"], row["sx"], row["sq"]))
    return {s: {r: _Cells(*(np.array(x, dtype=float) for x in zip(*rows_))) for r, rows_ in by.items()} for s, by in out.items()}


def optimal_borders(hist: DataFrame, ks: dict, series_col: str = "series") -> dict:
    """{(series, k): (centres, sse)} of the best clustering of each series into k ranges.

    ``hist``: (series, value, weight) with distinct non-null values (cache it; each round reads
    it once). With fewer values than k every value is a centre."""
    first = hist.groupBy(series_col).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.round(F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("m")).collect()
    shifts = {r[series_col]: r["m"] for r in first if r[series_col] in ks}
    ranges = {r[series_col]: [(r["lo"], r["hi"], CELLS)] for r in first if r[series_col] in ks}
    cells = {s: by[0] for s, by in _summed(hist, series_col, ranges, shifts).items()}
    out, known = {}, {s: {} for s in cells}
    while cells:
        ranges, runs, edges = {}, {}, {}
        for s, c in cells.items():
            found, split, edge = _bounds(c, ks[s], known[s])
            if split.any():
                runs[s], edges[s] = _runs(c, split, edge), edge
                ranges[s] = [(float(c.lo[a]), float(c.hi[e - 1]), _parts(c, a, e, split, len(runs[s]))) for a, e in runs[s]]
                continue
            sums = c.sums()
            for k in ks[s]:
                b = np.array(found.get(k) or range(len(c) + 1))  # fewer values than k: each is a range
                centres = (sums[1][b[1:]] - sums[1][b[:-1]]) / (sums[0][b[1:]] - sums[0][b[:-1]]) + shifts[s]
                out[(s, k)] = (centres.tolist(), float(_cost(sums, b[:-1], b[1:]).sum()))
        new = _summed(hist, series_col, ranges, shifts) if ranges else {}
        cells = {s: cells[s].replaced(runs[s], new[s], edges[s]) for s in ranges}
    return out


def _runs(c: _Cells, split: np.ndarray, edge: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches to divide anew: cells to split, with the single values between them."""
    kept = np.concatenate(([False], edge, [False]))
    member = split | (kept[:-1] & kept[1:])
    first = np.flatnonzero(member & ~np.concatenate(([False], member[:-1])))
    end = np.flatnonzero(member & ~np.concatenate((member[1:], [False]))) + 1
    some = np.add.reduceat(split, first) > 0
    first, end = first[some], end[some]
    if len(first) > STRETCHES:
        apart = c.lo[first[1:]] - c.hi[end[:-1] - 1]
        cut = np.sort(np.argsort(-apart, kind="stable")[:STRETCHES - 1])
        first, end = np.concatenate((first[:1], first[cut + 1])), np.concatenate((end[cut], end[-1:]))
    return list(zip(first.tolist(), end.tolist()))


def _parts(c: _Cells, a: int, e: int, split: np.ndarray, runs: int) -> int:
    extent = c.hi[e - 1] - c.lo[a]
    widest = (c.hi[a:e] - c.lo[a:e])[split[a:e]].max()
    return int(max(CELLS // runs, min(np.ceil(FINER * extent / widest), 2.0 ** 60)))
