"""Boosted trees against a search over every split, and joins of bucketed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopscope.operators import boost
from shopscope.sources.bucketed import bucketed_join, open_bucketed, write_bucketed
from tests.test_plans import plan


def brute(x, y, trees, depth, step):
    """(tree, node, feature, bin, rows, left, right) by trying every split on rows, and the predictions."""
    pred, out, scale = np.full(len(y), y.mean()), [], (y * y).sum()
    for t in range(1, trees + 1):
        res, value, nodes = y - pred, np.zeros(len(y)), {1: np.arange(len(y))}
        for _ in range(depth):
            later = {}
            for n, at in sorted(nodes.items()):
                best = None
                for f in range(x.shape[1]):
                    for b in np.unique(x[at, f])[:-1]:
                        low, high = at[x[at, f] <= b], at[x[at, f] > b]
                        gain = round((res[low].sum() ** 2 / len(low) + res[high].sum() ** 2 / len(high)
                                      - res[at].sum() ** 2 / len(at)) / scale, boost.DIGITS)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, b, low, high)
                if best:
                    _, f, b, low, high = best
                    out.append((t, n, f"f{f}", b, len(at), res[low].mean(), res[high].mean()))
                    value[low], value[high] = res[low].mean(), res[high].mean()
                    later[2 * n], later[2 * n + 1] = low, high
            nodes = later
        pred = pred + step * value
    return out, pred


def cells_of(spark, x, y):
    df = spark.createDataFrame([(*map(int, r), float(v)) for r, v in zip(x, y)], "f0_bin int, f1_bin int, f2_bin int, y double")
    return df.groupBy("f0_bin", "f1_bin", "f2_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


@pytest.mark.parametrize("seed, trees", [(1, 2), (2, 10)])
def test_trees_against_every_split(spark, seed, trees):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, (300, 3))
    x[:100] = x[0]  # a third of the rows are one cell
    y = x[:, 0] * 3.0 - (x[:, 1] > 3) * x[:, 2] + rng.normal(size=300)
    cells = cells_of(spark, x, y)
    depth = 3 if trees == 2 else 1  # ten trees cross the step at which predictions are written down
    model = boost.fit(cells, ["f0", "f1", "f2"], trees, depth, 0.3)
    want, pred = brute(x, y, trees, depth, 0.3)
    got = [s for t in model.trees for s in t]
    assert [(s.tree, s.node, s.feature, s.bin, s.rows) for s in got] == [w[:5] for w in want]
    assert np.allclose([(s.left, s.right) for s in got], [w[5:] for w in want])
    scored = {(r.f0_bin, r.f1_bin, r.f2_bin): r.p for r in cells.withColumn("p", model.prediction()).collect()}
    assert np.allclose([scored[tuple(map(int, r))] for r in x], pred)


def test_equal_labels_empty_cells_and_missing_bins(spark):
    cells = cells_of(spark, np.arange(6).reshape(2, 3), np.array([5.0, 5.0]))
    assert boost.fit(cells, ["f0", "f1", "f2"], 3) == boost.Boosted(5.0, 0.1, ())
    assert boost.fit(cells.where("false"), ["f0", "f1", "f2"], 3).trees == ()
    with pytest.raises(Exception, match="f0_bin is missing"):
        boost.fit(cells.withColumn("f0_bin", F.lit(None).cast("int")), ["f0", "f1", "f2"], 1)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    a = spark.range(1000).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")) \
        .union(spark.createDataFrame([(None, -1)], "k long, v long"))
    b = spark.range(0, 1000, 3).select(F.col("id").alias("key"), F.lit("x").alias("v"))
    write_bucketed(a, str(tmp_path / "a"), "k", 6)
    write_bucketed(b, str(tmp_path / "b"), "key", 6)
    assert len(list((tmp_path / "a").glob("part-*"))) <= 6
    left, right = (open_bucketed(spark, str(tmp_path / t), s, k, 6)
                   for t, s, k in (("a", a.schema, "k"), ("b", b.schema, "key")))
    assert left.columns == ["k", "v"] and left.count() == 1001
    j = bucketed_join(left, right, "k", "key")
    p = plan(j)
    assert "SortMergeJoin" in p and "Exchange" not in p
    keys = {r.key for r in b.collect()}
    want = sorted(v for v in range(1000) if (7 if v < 300 else v) in keys)
    assert sorted(r[1] for r in j.select(left.k, left.v).collect()) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    write_bucketed(b.where("false"), str(tmp_path / "none"), "key", 6)
    assert bucketed_join(left, open_bucketed(spark, str(tmp_path / "none"), b.schema, "key", 6), "k", "key").count() == 0
