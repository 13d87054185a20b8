"""Least-squares gradient boosting with exact split search over binned features.

The input is the cell table of ``models.regression_cells``: rows with equal bins are one cell with their
number and mean label. A tree costs one aggregation a level: sums of rows and residuals by (node, feature,
bin), running over the bins of each (node, feature), and only the best split of each node leaves Spark (at
most 2^(depth - 1) a level). A tree sees nothing of a row but its bins, so the cells give the trees that the
rows would, and after the one pass that builds the cells the cost doesn't grow with the data.

A split is ``bin <= b``. Its gain is the decrease of the squared error over the labels' sum of squares,
compared to 10 digits; ties go to the first feature, then the smallest bin. A node is left whole when
no split gains. Cells with a missing bin raise (an unseen value has no place in a tree).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopscope.session import materialize

DIGITS = 10
#: Trees whose sum stands in one expression before the running prediction is written down.
TREES_A_STEP = 8


@dataclass(frozen=True)
class BoostSplit:
    """Node numbers: the root is 1, the children of n are 2n (bin <= ``bin``) and 2n + 1."""

    tree: int
    node: int
    feature: str
    bin: int
    rows: int
    gain: float
    left: float
    right: float


@dataclass(frozen=True)
class Boosted:
    base: float
    step: float
    trees: tuple[tuple[BoostSplit, ...], ...]

    def prediction(self, first: int = 0) -> Column:
        """The base and all trees from ``first`` on, over columns ``{feature}_bin``."""
        out = F.lit(self.base) if first == 0 else F.lit(0.0)
        for t in self.trees[first:]:
            out = out + F.lit(self.step) * _value(t)
        return out


def _walk(tree: Sequence[BoostSplit], leaf) -> Column:
    by_node = {s.node: s for s in tree}

    def down(n: int, value: float) -> Column:
        if n not in by_node:
            return leaf(n, value)
        s = by_node[n]
        return F.when(F.col(f"`{s.feature}_bin`") <= F.lit(s.bin), down(2 * n, s.left)).otherwise(down(2 * n + 1, s.right))

    return down(1, 0.0)


def _value(tree: Sequence[BoostSplit]) -> Column:
    return _walk(tree, lambda n, value: F.lit(value))


def _node(tree: Sequence[BoostSplit]) -> Column:
    return _walk(tree, lambda n, value: F.lit(n))


def _level(cells: DataFrame, features: Sequence[str], tree: Sequence[BoostSplit], number: int,
           nodes: Sequence[int], scale: float) -> list[BoostSplit]:
    """The best split of each of ``nodes``, by the residuals ``__res`` of the cells."""
    bins = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{f}_bin`").alias("b")) for i, f in enumerate(features)])
    hist = cells.withColumn("node", _node(tree)).where(F.col("node").isin(list(nodes))) \
        .select("node", "n", "__res", F.inline(bins)) \
        .groupBy("node", "f", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("__res")).alias("g"))
    group = Window.partitionBy("node", "f")
    upto = group.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.select("node", "f", "b", F.sum("n").over(upto).alias("nl"), F.sum("g").over(upto).alias("gl"),
                      F.sum("n").over(group).alias("n"), F.sum("g").over(group).alias("g")).where("nl < n")
    nl, gl, n, g = (F.col(c) for c in ("nl", "gl", "n", "g"))
    gain = F.round((gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n) / F.lit(scale), DIGITS)
    best = run.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.min(F.struct(
        (-F.col("gain")).alias("loss"), "f", "b", n.alias("n"), (gl / nl).alias("left"), ((g - gl) / (n - nl)).alias("right"))).alias("s"))
    return [BoostSplit(number, r["node"], list(features)[r["f"]], r["b"], r["n"], -r["loss"], r["left"], r["right"])
            for r in best.select("node", "s.*").orderBy("node").collect()]


def fit(cells: DataFrame, features: Sequence[str], trees: int, depth: int = 5, step: float = 0.1) -> Boosted:
    """Boosted trees on cells with ``{feature}_bin, n, mean`` (empty cells: base 0 and no tree)."""
    for f in features:
        bin_of = F.col(f"`{f}_bin`")
        cells = cells.withColumn(f"{f}_bin", F.when(bin_of.isNull(), F.raise_error(F.lit(f"{f}_bin is missing")).cast("int")).otherwise(bin_of))
    cells = materialize(cells)
    n, mean = F.col("n"), F.col("mean")
    total = cells.agg((F.sum(n * mean) / F.sum("n")).alias("base"), F.sum(n * mean * mean).alias("scale")).first()
    if not total["scale"]:
        return Boosted(0.0, step, ())
    model = Boosted(total["base"], step, ())
    kept, first = cells.withColumn("__pred", F.lit(0.0)), 0
    for number in range(1, trees + 1):
        if number - first > TREES_A_STEP:
            kept = materialize(kept.withColumn("__pred", F.col("__pred") + model.prediction(first)))
            first = number - 1
        left = kept.withColumn("__res", mean - (F.col("__pred") + model.prediction(first)))
        tree, nodes = [], [1]
        for _ in range(depth):
            new = _level(left, features, tree, number, nodes, total["scale"])
            if not new:
                break
            tree += new
            nodes = [c for s in new for c in (2 * s.node, 2 * s.node + 1)]
        if not tree:
            break
        model = Boosted(model.base, step, (*model.trees, tuple(tree)))
    return model


def splits(cells: DataFrame, model: Boosted, edges: dict[str, list[float]]) -> DataFrame:
    """All splits as rows, with the value (edge) that bounds each split's bin."""
    rows = [(s.tree, s.node, s.feature, float(edges[s.feature][s.bin]), s.rows, s.gain, s.left, s.right)
            for t in model.trees for s in t]
    return cells.sparkSession.createDataFrame(
        rows, "tree int, node int, feature string, threshold double, rows bigint, gain double, left_value double, right_value double")
