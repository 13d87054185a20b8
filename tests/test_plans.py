"""Physical-plan checks: pushdown, pruning, top-k, broadcast of fixed-size inputs, no Python."""

import pytest

import __spark_entry__ as entry
from shopscope.operators import explore
from shopscope.plans.queries import QUERIES
from shopscope.sources import standins
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_take_ordered(spark):
    p = plan(explore.best_sellers(standins.fact_table(spark, SMALL), 10))
    assert "TakeOrderedAndProject" in p


def test_year_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    df = explore.monthly_category_counts(
        o.withColumnRenamed("o_orderdate", "order_purchase_timestamp")
         .withColumn("category", F.col("o_orderstatus")), ["F"], 1997)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_scan_prunes_columns(spark):
    p = plan(entry.queries()["counts_by_state"](spark, SMALL))
    li = [ln for ln in p.splitlines() if "lineitem.parquet" in ln or "ReadSchema" in ln]
    assert li
    lineitem_schema = [ln for ln in p.split("FileScan") if "lineitem" in ln][0]
    assert "l_extendedprice" not in lineitem_schema.split("ReadSchema")[1].split("\n")[0]


def test_nation_broadcast(spark):
    p = plan(standins.customer_locations(spark, SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation(spark, name):
    if name in ("price_gbt_metrics", "price_gbt_predictions", "value_classifier_confusion", "value_classifier_accuracy"):
        pytest.skip("plan build fits hundreds of trees; value_classifier_metrics stands for its kind")
    p = plan(entry.queries()[name](spark, SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_top_values_limits_before_shuffle(spark):
    from shopscope.operators import profile
    df = profile.top_values(standins.fact_table(spark, SMALL), ["customer_state", "order_id"], 5)
    df.collect()
    p = plan(df)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_cross_join_in_customer_measures(spark):
    p = plan(entry.queries()["customer_recency"](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Subquery" in p


def test_orders_are_merged_at_any_size(spark):
    """A broadcast of the orders is no plan that grows with them; the small tables may still be broadcast."""
    fact = standins.fact_table(spark, SMALL)
    assert "SortMergeJoin [l_orderkey" in plan(fact)
    assert plan(fact).count("SortMergeJoin") == 1


@pytest.mark.parametrize("name", ["corr_matrix", "price_linear_metrics", "price_linear_predictions", "clv_target_corr", "tree_importance"])
def test_results_of_several_passes_join_once(spark, name, monkeypatch):
    """The fact is read for one stored table, which is gone when the result stands."""
    from shopscope.plans import queries
    from shopscope.session import stored
    import contextlib
    import os
    folders = []

    @contextlib.contextmanager
    def seen(df, tag):
        with stored(df, tag) as rows:
            folders.append((tag, rows.inputFiles()[0]))
            yield rows

    monkeypatch.setattr(queries, "stored", seen)
    got = QUERIES[name](spark, SMALL)
    assert "lineitem" not in plan(got) and got.count() > 0
    assert folders and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for _, f in folders)


@pytest.mark.parametrize("name", ["target_corr", "price_linear_coefficients", "price_gbt_predictions", "value_classifier_confusion"])
def test_joined_rows_are_read_once(spark, name, monkeypatch):
    """One stored table takes the joins; the model's rounds, here a few, don't matter."""
    from functools import partial

    from shopscope.operators import models
    from shopscope.plans import queries
    from shopscope.session import stored
    tags = []
    monkeypatch.setattr(queries, "stored", lambda df, tag: tags.append(tag) or stored(df, tag))
    for fit in ("fit_gbt_regressor", "fit_value_classifier"):
        monkeypatch.setattr(models, fit, partial(getattr(models, fit), max_iter=1))
    got = QUERIES[name](spark, SMALL)
    assert len(tags) == 1 and "lineitem" not in plan(got) and got.count() > 0


def test_clv_study_reads_the_input_once(spark, scratch):
    """Only the first stage reads the given rows: the later ones stand on its table."""
    from shopscope.operators import study
    from shopscope.plans import queries
    rows = queries._clv_rows(spark, SMALL)
    read = spark.sparkContext.accumulator(0)
    counted = rows.rdd.map(lambda r: read.add(1) or r).toDF(rows.schema)
    got = study.clv_study(counted, f"{scratch}/clv-study-once", queries.WINDOWS, "long", list(queries.ROW_KEYS))
    assert got.count() > 0 and read.value == rows.count()
