"""Recency, frequency, revenue: per-customer measures, clusters, overall score, value class.

Execution: one ``groupBy(customer)`` (partial aggregation before the shuffle) yields all
three measures; the global last purchase is a scalar subquery over that result. Each 1-D clustering runs on the measure's (value, rows) histogram (see
``operators.cluster``), so the fact table is not rescanned per iteration. Cluster labels
are added with a k-leaf comparison expression; ranks come from a k-row map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.functions import nearest_sorted_centre, score_class, whole_days
from shopscope.operators.cluster import LLOYD_MAX_ITER, best_centres, kmeans_1d, kmeans_ml

CLV_COLUMNS = ("order_id", "product_id", "order_purchase_timestamp", "payment_value", "price",
               "customer_unique_id", "geolocation_state")


def clv_base(fact: DataFrame) -> DataFrame:
    """The seven columns the customer-value study works on."""
    return fact.select(*CLV_COLUMNS)


def summary(base: DataFrame, ts_col: str = "order_purchase_timestamp",
            customer_col: str = "customer_unique_id", sales_col: str = "price") -> DataFrame:
    """First and last purchase date, distinct customers, total sales (one row)."""
    return base.agg(F.min(F.to_date(ts_col)).alias("min_date"),
                    F.max(F.to_date(ts_col)).alias("max_date"),
                    F.count_distinct(customer_col).alias("unique_customers"),
                    F.coalesce(F.sum(sales_col), F.lit(0.0)).alias("total_sales"))


def customer_measures(base: DataFrame, customer_col: str = "customer_unique_id",
                      ts_col: str = "order_purchase_timestamp", value_col: str = "payment_value",
                      distinct_orders: bool = False, order_col: str = "order_id",
                      revenue_digits: int | None = 2,
                      windows: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Per customer: ``last_purchase, recency, frequency, revenue, rows`` and, for each named
    date window, ``rows_{name}`` (rows inside it) and ``paid_{name}`` (payments inside it).

    * recency: whole days from the customer's last purchase to the latest purchase of all,
    * frequency: rows with a purchase time (``distinct_orders`` counts orders instead),
    * revenue: sum of ``value_col`` (0 when all null), rounded to ``revenue_digits``,
    * rows: the customer's row count (the weight of the customer in row-level statistics).
    Rows without a customer are ignored. All of it is one aggregation over the detail rows
    (partial aggregation before the shuffle), so nothing downstream rescans them.
    """
    from shopscope.operators.clv import in_window  # the window predicate lives with CLV

    freq = F.count_distinct(order_col) if distinct_orders else F.count(ts_col)
    rev = F.coalesce(F.sum(value_col), F.lit(0.0))
    if revenue_digits is not None:
        rev = F.round(rev, revenue_digits)
    extra = []
    for name, (start, end) in (windows or {}).items():
        inside = in_window(ts_col, start, end)
        extra += [F.count(F.when(inside, F.lit(1))).alias(f"rows_{name}"),
                  F.coalesce(F.sum(F.when(inside, F.col(value_col))), F.lit(0.0)).alias(f"paid_{name}")]
    per = (base.where(F.col(customer_col).isNotNull()).groupBy(customer_col)
           .agg(F.max(ts_col).alias("last_purchase"), freq.alias("frequency"),
                rev.alias("revenue"), F.count(F.lit(1)).alias("rows"), *extra))
    latest = per.agg(F.max("last_purchase")).scalar()  # scalar subquery, evaluated once
    window_cols = [c for name in (windows or {}) for c in (f"rows_{name}", f"paid_{name}")]
    return (per.withColumn("recency", whole_days("last_purchase", latest).cast("int"))
            .select(customer_col, "last_purchase", "recency", "frequency", "revenue", "rows",
                    *window_cols))


@dataclass(frozen=True)
class ClusterSpec:
    """One 1-D clustering: ``measure`` into ``k`` ranked clusters, written to ``out_col``
    (default ``{measure}_cluster``), optionally only for rows where ``where`` holds."""
    measure: str
    k: int
    ascending: bool = True
    where: object = None
    out_col: str | None = None

    @property
    def name(self) -> str:
        return self.out_col or f"{self.measure}_cluster"

    def value(self) -> F.Column:
        v = F.col(self.measure).cast("double")
        return v if self.where is None else F.when(self.where, v)


DEFAULT_SPECS = (ClusterSpec("recency", 4), ClusterSpec("frequency", 4), ClusterSpec("revenue", 3))


def rank_map_expr(cluster: F.Column, ranks: dict[int, int]) -> F.Column:
    """Cluster id -> rank as a CASE over k literal entries."""
    expr = None
    for cid, r in sorted(ranks.items()):
        expr = (F.when(cluster == cid, F.lit(r)) if expr is None
                else expr.when(cluster == cid, F.lit(r)))
    return expr


def measure_histograms(per_customer: DataFrame, specs, weight_col: str = "rows") -> DataFrame:
    """(series, value, weight) for several clusterings in one aggregation."""
    recs = F.array(*[F.struct(F.lit(s.name).alias("series"), s.value().alias("value"))
                     for s in specs])
    return (per_customer.select(F.inline(recs), F.col(weight_col).alias("__w"))
            .where(F.col("value").isNotNull())
            .groupBy("series", "value").agg(F.sum("__w").cast("double").alias("weight")))


def fit_ranked_clusters(per_customer: DataFrame, specs, weight_col: str = "rows",
                        max_iter: int = LLOYD_MAX_ITER, method: str = "best"
                        ) -> dict[str, tuple[list[float], dict[int, int]]]:
    """For each spec: ascending centres and the map cluster id -> rank of the cluster's
    weighted mean. One histogram job and one aggregation per round serve all specs.

    ``method``: ``"best"`` (the optimum), ``"lloyd"`` (local, from quantiles) or ``"ml"``."""
    specs = list(specs)
    hist = measure_histograms(per_customer, specs, weight_col).cache()
    try:
        if method == "ml":
            centres = {s.name: kmeans_ml(hist.where(F.col("series") == s.name), "value",
                                         s.k, "weight") for s in specs}
        else:
            ks = {s.name: s.k for s in specs}
            fitted = (best_centres(hist, ks, "series") if method == "best" else
                      kmeans_1d(hist, ks, max_iter, cache=False, series_col="series"))
            centres = {s.name: fitted[(s.name, s.k)] for s in specs}
        lab = None
        for s in specs:
            e = nearest_sorted_centre("value", centres[s.name])
            lab = (F.when(F.col("series") == s.name, e) if lab is None
                   else lab.when(F.col("series") == s.name, e))
        means = (hist.groupBy("series", lab.alias("cluster"))
                 .agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("m"))
                 .collect())
    finally:
        hist.unpersist()
    out = {}
    for s in specs:
        rows = [r for r in means if r["series"] == s.name]
        order = sorted(rows, key=lambda r: ((r["m"] if s.ascending else -r["m"]), r["cluster"]))
        out[s.name] = (centres[s.name], {r["cluster"]: i for i, r in enumerate(order)})
    return out


def add_ranked_clusters(per_customer: DataFrame, specs, max_iter: int = LLOYD_MAX_ITER,
                        method: str = "best", weight_col: str = "rows") -> DataFrame:
    """Fits every spec together and adds its ranked cluster column (null where the spec's
    ``where`` is false)."""
    fitted = fit_ranked_clusters(per_customer, specs, weight_col, max_iter=max_iter, method=method)
    out = per_customer
    for s in specs:
        centres, ranks = fitted[s.name]
        lab = rank_map_expr(nearest_sorted_centre(F.col(s.measure).cast("double"), centres), ranks)
        out = out.withColumn(s.name, lab if s.where is None else F.when(s.where, lab))
    return out


def rfm_clusters(per_customer: DataFrame, specs=DEFAULT_SPECS, max_iter: int = LLOYD_MAX_ITER,
                 method: str = "best", extra_specs=()) -> DataFrame:
    """Adds the ranked ``{measure}_cluster`` columns, ``overall_score`` (their sum) and
    ``category``. ``extra_specs`` are fitted in the same iterations but not scored."""
    specs = list(specs)
    out = add_ranked_clusters(per_customer, specs + list(extra_specs), max_iter, method)
    score = sum((F.col(s.name) for s in specs[1:]), F.col(specs[0].name))
    return out.withColumn("overall_score", score).withColumn("category", score_class("overall_score"))


def attach_to_rows(base: DataFrame, per_customer: DataFrame,
                   customer_col: str = "customer_unique_id") -> DataFrame:
    """Every detail row with its customer's measures (inner join, as the merge does).

    The per-customer side has one row per customer; AQE broadcasts it when small and
    otherwise splits a hot customer's partition of the detail side.
    """
    return base.join(per_customer.drop("rows", "last_purchase"), customer_col, "inner")


def score_means(per_customer: DataFrame) -> DataFrame:
    """Mean recency, frequency and revenue per overall score, over rows (weights = rows)."""
    def wmean(c: str) -> F.Column:
        return (F.sum(F.col(c) * F.col("rows")) / F.sum("rows")).alias(c)
    return (per_customer.groupBy("overall_score")
            .agg(wmean("recency"), wmean("frequency"), wmean("revenue"))
            .orderBy("overall_score"))


def scatter(points: DataFrame, x: str, y: str, limits: dict[str, float],
            category_col: str = "category", weight_col: str | None = "rows") -> DataFrame:
    """Points under the outlier limits (strict), with their class and multiplicity:
    ``category, x, y, n`` (n = rows at that point)."""
    cond = None
    for c, lim in limits.items():
        e = F.col(c) < F.lit(lim)
        cond = e if cond is None else cond & e
    kept = points.where(cond) if cond is not None else points
    n = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    return (kept.groupBy(category_col, F.col(x).alias("x"), F.col(y).alias("y"))
            .agg(n.cast("bigint").alias("n")))
