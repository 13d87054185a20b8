"""Hand-computed edge cases (FIXTURES.md section 4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shopscope.functions import pct_error, round_half_even, score_class, whole_days
from shopscope.operators import cleaning, clv, cluster, explore, joins, models, profile, stats


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_e1_count_non_null(spark):
    df = spark.createDataFrame([("g", "a"), ("g", None)], "k string, v string")
    assert rows(df.groupBy("k").agg(F.count("v").alias("n")), "n") == [(1,)]


def test_e2_sum_all_null_is_zero(spark):
    df = spark.createDataFrame([("b", None)], "category string, price double")
    out = explore.best_sellers(df, 5, "category", "price")
    assert rows(out, "category", "total") == [("b", 0.0)]


def test_e3_null_group_key_dropped(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (2, 3.0)], "k int, v double")
    out = profile.describe_by(df, "v", "k")
    assert sorted(r["k"] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("method", ["exact", "percentile"])
def test_e4_describe(spark, method):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = profile.describe(df, "x", method=method).first()
    assert r["count"] == 4 and r["mean"] == 2.5
    assert math.isclose(r["std"], 1.2909944487, rel_tol=1e-9)
    assert (r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (1.0, 1.75, 2.5, 3.25, 4.0)


def test_quantiles_exact_matches_builtin_with_skew(spark):
    # one value holds a third of the rows; many buckets; grouped
    data = [("a", 7.0)] * 300 + [("a", float(i)) for i in range(600)] + \
           [("b", float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    exact = {(r["g"], r["p"]): r["value"] for r in
             profile.quantiles(df, "x", probs, by=["g"]).collect()}
    ref = {(r["g"], r["p"]): r["value"] for r in
           profile.quantiles(df, "x", probs, by=["g"], method="percentile").collect()}
    assert exact.keys() == ref.keys()
    for k in ref:
        assert math.isclose(exact[k], ref[k], rel_tol=1e-12, abs_tol=1e-12), k


def test_weighted_quantile_equals_repeated_rows(spark):
    w = spark.createDataFrame([(1.0, 3), (5.0, 1), (2.0, 2)], "x double, w int")
    rep = spark.createDataFrame([(1.0,)] * 3 + [(5.0,)] + [(2.0,)] * 2, "x double")
    a = profile.quantiles(w, "x", [0.3, 0.5, 0.9], weight_col="w").orderBy("p").collect()
    b = profile.quantiles(rep, "x", [0.3, 0.5, 0.9], method="percentile").orderBy("p").collect()
    assert [round(r["value"], 12) for r in a] == [round(r["value"], 12) for r in b]


def test_e5_corr_pairwise_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 5.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.corr_matrix(df, ["a", "b"]).collect()}
    assert math.isclose(m[("a", "b")], 0.5765566602, rel_tol=1e-9)
    assert m[("a", "b")] == m[("b", "a")]


def test_e6_e7_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.corr_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None
    assert stats.corr_pairs(df, ["a", "b"], 0.3).count() == 0


def test_e8_top_k_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 3.0)], "c string, v double")
    assert rows(explore.best_sellers(df, 2, "c", "v"), "c") == [("b",), ("c",)]


def test_e9_window_inclusive_end_day(spark):
    ts = [dt.datetime(2016, 10, 1), dt.datetime(2017, 6, 1, 23), dt.datetime(2017, 6, 2)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    kept = df.where(clv.in_window("ts", "2016-10-01", "2017-06-01")).collect()
    assert [r["ts"] for r in kept] == ts[:2]


def test_e10_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 2), dt.datetime(2020, 1, 2, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(whole_days("a", "b").alias("d"),
                  F.datediff(F.to_date("b"), F.to_date("a")).alias("cal")).first()
    assert (r["d"], r["cal"]) == (0, 1)


def test_e11_half_even(spark):
    r = spark.range(1).select(round_half_even(F.lit(0.125), 2).alias("x")).first()
    assert float(r["x"]) == 0.12


def test_e12_pct_error_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert [r["e"] for r in df.select(pct_error("y", "p").alias("e")).collect()] == [None, 50.0]


def test_e13_e14_e15_clean(spark):
    n = 100
    data = []
    for i in range(n):
        data.append((
            i,
            None if i < 50 else 1.0,            # exactly 0.5 null -> dropped
            None if i < 49 else 1.0,            # 0.49 null -> kept
            None if i < 4 else 1.0,             # 0.04 -> rows dropped
            None if i < 5 else 1.0,             # 0.05 -> rows kept (not < 0.05)
            None if i % 10 == 9 else ("x" if i % 3 else "y"),  # mode source, 10 % null
            None if i % 7 == 0 else 2.0,        # numeric, stays null
            7, 8,                               # suffix pair
        ))
    df = spark.createDataFrame(data, "id int, half double, most double, few double, five double, "
                                     "lead_behaviour_profile string, num double, z_x int, z_y int")
    out = cleaning.clean(df)
    assert "half" not in out.columns and "most" in out.columns
    assert "z_x" not in out.columns and "z" in out.columns and "z_x" not in out.columns
    assert out.count() == n - 4
    assert out.where(F.col("lead_behaviour_profile").isNull()).count() == 0
    assert out.where(F.col("num").isNull()).count() > 0


def test_e16_mode_tie(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("y",)], "v string")
    assert profile.mode_of(df, "v") == "x"


def test_e17_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    right = spark.createDataFrame([(None, "a"), (2, "b")], "k int, v string")
    assert joins.join_with_suffixes(left, right, "k").count() == 1
    assert joins.join_with_suffixes(left, right, "k", null_safe=True).count() == 2


def test_e18_lookup_drops_unmatched_and_null(spark):
    df = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3)], "c string, v int")
    lk = spark.createDataFrame([("a", "A")], "c string, e string")
    assert rows(joins.lookup_join(df, lk, "c"), "v") == [(1,)]


def test_e19_suffixes(spark):
    left = spark.createDataFrame([(1, "s1")], "customer_id int, seller_id string")
    right = spark.createDataFrame([(1, "s2")], "customer_id int, seller_id string")
    j = joins.join_with_suffixes(left, right, "customer_id")
    assert set(j.columns) == {"customer_id", "seller_id_x", "seller_id_y"}
    c = cleaning.strip_suffix(cleaning.drop_suffixed(j))
    assert rows(c, "seller_id") == [("s2",)]


def test_e20_pivot_missing_cells(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "m int, c string, v double")
    out = explore.pivot_sum(df, "m", "c", "v", ["x", "y"])
    assert rows(out, "m", "x", "y") == [(1, 1.0, None), (2, None, 2.0)]


def test_e21_score_class(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, 4, 8)], "s int")
    got = [r["c"] for r in df.select(score_class("s").alias("c")).collect()]
    assert got == ["low_value", "low_value", "mid_value", "mid_value", "high_value", "high_value"]


def test_e22_one_hot_fixed_vocabulary(spark):
    df = spark.createDataFrame([("low_value",)], "category string")
    out = clv.one_hot_classes(df, drop=())
    assert rows(out, "category_high_value", "category_low_value", "category_mid_value") == [(0, 1, 0)]


def test_e23_order_cluster(spark):
    df = spark.createDataFrame([(0, 9.0), (1, 2.0), (2, 5.0)], "cl int, t double")
    out = cluster.order_cluster(df, "cl", "t")
    assert sorted(rows(out, "t", "cl")) == [(2.0, 0), (5.0, 1), (9.0, 2)]


def test_e24_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert rows(profile.histogram(df, "x", 2), "bin", "n") == [(0, 1), (1, 2)]


def test_e25_f_beta(spark):
    # class 0: tp 1, predicted 2 (precision .5), actual 1 (recall 1)
    conf = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, 3)], "label int, prediction int, n long")
    m = {r["class"]: r for r in models.per_class_metrics(conf, 2.0).collect()}
    assert math.isclose(m[0]["f_beta"], 5 * 0.5 / (4 * 0.5 + 1))
    assert (m[0]["tp"], m[0]["fp"], m[0]["fn"], m[0]["tn"]) == (1, 1, 0, 3)


def test_e26_kmeans_k1_sse(spark):
    hist = cluster.value_histogram(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v")
    sse = {r["k"]: r["sse"] for r in cluster.elbow(hist, [1, 2]).collect()}
    assert sse[1] == 5.0 and sse[2] <= sse[1]


def test_e27_p99_trim(spark):
    df = spark.createDataFrame([(float(x), 1) for x in range(1, 101)], "v double, rows int")
    q = profile.quantiles(df, "v", [0.99]).first()["value"]
    assert math.isclose(q, 99.01)
    assert clv.trim_upper(df, "v", 0.99).count() == 99


def test_e28_target_excluded(spark):
    df = spark.createDataFrame([(float(x), float(x), float(x % 3)) for x in range(10)], "t double, same double, o double")
    out = stats.target_corr(df, "t", ["same", "o"], 0.0)
    assert "same" not in [r["feature"] for r in out.collect()]


def test_e29_window_value_left_join_fill(spark):
    per = spark.createDataFrame([("c1", 10.0, 2), ("c2", 5.0, 0)], "customer_unique_id string, revenue double, rows_long long")
    out = {r["customer_unique_id"]: r["m14_revenue"] for r in clv.window_value(per, "long").collect()}
    assert out == {"c1": 20.0, "c2": 0.0}


def test_kmeans_1d_matches_lloyd_by_hand(spark):
    vals = [1.0, 2.0, 3.0, 10.0, 11.0, 12.0, 30.0]
    hist = cluster.value_histogram(spark.createDataFrame([(v,) for v in vals], "v double"), "v")
    c = cluster.kmeans_1d(hist, 2, 50)[2]
    # start: quantiles .25/.75 of the distinct values = 2.5, 11.5; midpoint 7 splits
    # {1,2,3} | {10,11,12,30} -> centres 2, 15.75; midpoint 8.875 keeps the split (fixed point)
    assert [round(x, 9) for x in c] == [2.0, 15.75]


def test_kmeans_ml_mode(spark):
    vals = [1.0, 2.0, 3.0, 100.0, 101.0]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "value double, weight double")
    c = cluster.kmeans_ml(df, "value", 2, "weight")
    assert [round(x, 6) for x in c] == [2.0, 100.5]
