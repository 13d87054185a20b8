"""Invariants for the model-based (rows-only) queries."""

import math

import __spark_entry__ as entry
from tests.conftest import SMALL

Q = entry.queries()


def test_explained_variance(spark):
    rows = Q["explained_variance"](spark, SMALL).orderBy("component").collect()
    pct = [r["pct_variance"] for r in rows]
    assert math.isclose(sum(pct), 100.0, abs_tol=1e-2)
    assert all(a >= b - 1e-9 for a, b in zip(pct, pct[1:]))
    assert math.isclose(rows[-1]["cum_pct"], 100.0, abs_tol=1e-2)


def test_tree_importance_sums_to_one(spark):
    imp = [r["importance"] for r in Q["tree_importance"](spark, SMALL).collect()]
    assert math.isclose(sum(imp), 1.0, abs_tol=1e-3) and min(imp) >= 0


def test_elbow_non_increasing(spark):
    sse = [r["sse"] for r in Q["elbow_curve"](spark, SMALL).orderBy("k").collect()]
    assert len(sse) == 7
    assert all(b <= a * (1 + 1e-9) for a, b in zip(sse, sse[1:]))


def test_gbt_and_linear_metrics(spark):
    lin = {r["split"]: r for r in Q["price_linear_metrics"](spark, SMALL).collect()}
    gbt = {r["split"]: r for r in Q["price_gbt_metrics"](spark, SMALL).collect()}
    assert lin["train"]["r2"] >= 0
    assert gbt["train"]["r2"] >= lin["train"]["r2"] - 1e-6
    assert lin["train"]["n"] + lin["test"]["n"] == gbt["train"]["n"] + gbt["test"]["n"]


def test_confusion_sums_to_test_rows(spark):
    conf = Q["value_classifier_confusion"](spark, SMALL).collect()
    acc = {r["split"]: r for r in Q["value_classifier_accuracy"](spark, SMALL).collect()}
    assert sum(r["n"] for r in conf) == acc["test"]["n"]
