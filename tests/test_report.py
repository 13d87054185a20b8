"""Profiles of all column types, mergeable states, automatic bins."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopscope.operators import profile, report
from shopscope.sources import standins
from shopscope.sources.tables import read_facts, write_facts
from tests.conftest import SMALL

SCHEMA = "i int, d double, s string, t timestamp_ntz, day date, b boolean, l array<int>, `dot.ted` string, none string, amount decimal(10,2)"


@pytest.fixture(scope="module")
def frame(spark):
    when = dt.datetime(2020, 1, 2, 3, 4, 5)
    rows = [(1, 1.5, "x", when, dt.date(2020, 1, 1), True, [1], "p", None, 1), (1, float("nan"), "x", when, dt.date(2021, 1, 1), False, [1], "q", None, 2),
            (2, None, "", None, None, None, None, "q", None, None), (None, 2.5, None, dt.datetime(2019, 1, 1), None, True, [2], None, None, 2)]
    return spark.createDataFrame([(*r[:9], None if r[9] is None else __import__("decimal").Decimal(r[9])) for r in rows], SCHEMA)


def test_every_type(spark, frame, tmp_path):
    path = str(tmp_path / "report")
    write_facts(report.profile_columns(frame), path)
    got = {r["column"]: r for r in read_facts(spark, path).collect()}
    assert list(r["column"] for r in report.profile_columns(frame).collect()) == frame.columns
    assert (got["i"].n, got["i"].n_null, got["i"].n_distinct, got["i"]["min"], got["i"]["max"], got["i"].p50) == (3, 1, 2, 1, 2, 1)
    assert (got["d"].n, got["d"].n_null, got["d"]["mean"], got["d"].dtype) == (2, 2, 2.0, "double")
    assert [(x.value, x.n) for x in got["s"].top] == [("x", 2), ("", 1)] and got["s"].min_text == ""
    assert (got["t"].min_text, got["t"].n_distinct) == ("2019-01-01 00:00:00.000000", 2)
    assert (got["day"].max_text, got["day"].dtype) == ("2021-01-01", "date")
    assert [(x.value, x.n) for x in got["b"].top] == [("true", 2), ("false", 1)]
    assert [(x.value, x.n) for x in got["l"].top] == [('{"v":[1]}', 2), ('{"v":[2]}', 1)]
    assert got["dot.ted"].n_distinct == 2 and (got["none"].n, got["none"].null_pct, got["none"].top) == (0, 100.0, None)
    assert [x.value for x in got["amount"].top] == ["2.000000", "1.000000"]


def test_no_rows(frame):
    got = report.profile_columns(frame.where("false")).collect()
    assert [r["column"] for r in got] == frame.columns and all(r.n == 0 and r.null_pct is None and r.top is None for r in got)


def test_states_merge_like_one_table(spark):
    fact = standins.fact_with_gaps(spark, SMALL).select("price", "order_status", "order_purchase_timestamp", "declared_monthly_revenue", "line_number")
    parts = [report.profile_sketch(fact.where(F.pmod(F.xxhash64("price"), F.lit(3)) == i)) for i in range(3)]
    merged = {r["column"]: r for r in report.sketch_report(report.merge_sketches(*parts), fact).collect()}
    by_day = report.merge_sketches(report.profile_sketch(fact, ["price"], by=["line_number"]))
    exact = {r["column"]: r for r in report.profile_columns(fact).collect()}
    assert set(merged) == set(exact)
    for c, e in exact.items():
        m = merged[c]
        assert (m.dtype, m.n, m.n_null, m.min_text, m.max_text, m["min"], m["max"]) == (e.dtype, e.n, e.n_null, e.min_text, e.max_text, e["min"], e["max"])
        assert abs(m.n_distinct - e.n_distinct) <= 0.05 * e.n_distinct + 1
        if e["mean"] is not None:
            assert math.isclose(m["mean"], e["mean"], rel_tol=1e-9) and math.isclose(m.std, e.std, rel_tol=1e-9)
    assert {(x.value, x.n) for x in merged["order_status"].top} == {(x.value, x.n) for x in exact["order_status"].top}
    row = by_day.first()
    assert row.n == exact["price"].n and math.isclose(math.sqrt(row.v * row.n / (row.n - 1)), exact["price"].std, rel_tol=1e-9)


@pytest.mark.parametrize("values", [[1, 1, 1, 1], [1, 2, 3, 4, 5, 6, 7, 100], list(range(500)), [0.5] * 50 + [3.25], [7]])
def test_auto_bins_follow_the_data(spark, values):
    df = spark.createDataFrame([(float(v), 2) for v in values] + [(None, 2)], "x double, w int")
    got = profile.auto_histogram(df, "x", "w").collect()
    x = np.repeat(np.array(values, dtype=float), 2)
    iqr, extent, n = np.subtract(*np.percentile(x, [75, 25])), np.ptp(x), len(x)
    width = min(w for w in (2 * iqr * n ** (-1 / 3) or math.inf, extent / (math.log2(n) + 1)))
    bins = min(math.ceil(extent / width), 1000) if extent else 1
    counts, edges = np.histogram(x, bins=bins, range=(x.min(), x.max() if extent else x.min() + 1))
    assert sum(r.n for r in got) == n
    assert {r.bin: r.n for r in got} == {i: int(c) for i, c in enumerate(counts) if c}


def test_bins_are_bounded(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(400)] + [(1e9,)], "x double")
    got = profile.auto_histogram(df, "x", max_bins=64).collect()
    assert max(r.bin for r in got) == 63 and sum(r.n for r in got) == 401
