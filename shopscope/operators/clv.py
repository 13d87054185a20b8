"""Customer lifetime value: date windows, window value, outlier trim, value clusters,
one-hot class indicators.

Everything is per customer with a ``rows`` weight: a row-level statistic over the fact
(a quantile, a cluster mean) equals the weighted statistic over customers, and the
per-customer frame is orders of magnitude smaller than the fact table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.functions import nearest_sorted_centre, one_hot
from shopscope.operators.cluster import LLOYD_MAX_ITER
from shopscope.operators.profile import quantiles
from shopscope.operators.rfm import ClusterSpec, fit_ranked_clusters, rank_map_expr

WINDOW_COLUMNS = ("customer_unique_id", "recency", "recency_cluster", "frequency",
                  "frequency_cluster", "revenue", "revenue_cluster", "overall_score", "category")
CATEGORIES = ("high_value", "low_value", "mid_value")


def in_window(ts: F.Column | str, start: str, end: str) -> F.Column:
    """start <= ts < end + 1 day: both ends inclusive, the end day as a whole."""
    t = F.col(ts) if isinstance(ts, str) else ts
    s = dt.datetime.fromisoformat(start)
    e = dt.datetime.fromisoformat(end) + dt.timedelta(days=1)
    lo = F.lit(s.isoformat(sep=" ")).cast("timestamp_ntz")
    hi = F.lit(e.isoformat(sep=" ")).cast("timestamp_ntz")
    return (t >= lo) & (t < hi)


def window_rows(rows: DataFrame, start: str, end: str, ts_col: str = "order_purchase_timestamp",
                with_clv: bool = False) -> DataFrame:
    """Detail rows inside the window, projected to the customer-value columns
    (plus ``CLV`` = revenue when ``with_clv``)."""
    out = rows.where(in_window(ts_col, start, end)).select(*WINDOW_COLUMNS)
    return out.withColumn("CLV", F.col("revenue")) if with_clv else out


def window_customers(per_customer: DataFrame, window: str, with_clv: bool = False) -> DataFrame:
    """The window's detail rows collapsed per customer, from the per-customer table's
    ``rows_{window}`` count: the customer-value columns, optional ``CLV`` (= revenue) and
    ``rows`` = the customer's rows in the window. No rescan of the detail rows."""
    cols = [F.col(c) for c in WINDOW_COLUMNS]
    if with_clv:
        cols.append(F.col("revenue").alias("CLV"))
    return (per_customer.where(F.col(f"rows_{window}") > 0)
            .select(*cols, F.col(f"rows_{window}").alias("rows")))


def window_value(per_customer: DataFrame, window: str, measure: str = "revenue",
                 name: str = "m14_revenue") -> DataFrame:
    """Per customer: value in the window (0 when the customer has no row there).

    ``measure="revenue"`` sums the customer's total revenue once per window row (the
    original definition: revenue x rows in the window); ``measure="payment_value"`` sums
    the payments inside the window.
    """
    if measure == "revenue":
        val = F.col("revenue") * F.col(f"rows_{window}")
    elif measure == "payment_value":
        val = F.col(f"paid_{window}")
    else:
        raise ValueError(measure)
    return per_customer.withColumn(name, F.coalesce(val, F.lit(0.0)))


def upper_quantile(df: DataFrame, column: str, q: float = 0.99,
                   weight_col: str | None = "rows") -> float | None:
    """The q-quantile of ``column`` over weighted rows, as a scalar."""
    r = quantiles(df, column, [q], weight_col=weight_col).first()
    return None if r is None else r["value"]


def trim_upper(df: DataFrame, column: str, q: float = 0.99, weight_col: str | None = "rows") -> DataFrame:
    """Keep rows with column < its q-quantile (strict), the quantile taken over weighted rows."""
    qv = quantiles(df, column, [q], weight_col=weight_col).select("value").scalar()
    return df.where(F.col(column) < qv)


def value_clusters(df: DataFrame, column: str = "m14_revenue", k: int = 3,
                   out_col: str = "CLV_cluster", max_iter: int = LLOYD_MAX_ITER, method: str = "best") -> DataFrame:
    """Ranked 1-D clusters of the window value (row-weighted)."""
    spec = ClusterSpec(column, k, out_col=out_col)
    centres, ranks = fit_ranked_clusters(df, [spec], "rows", max_iter, method)[spec.name]
    lab = nearest_sorted_centre(F.col(column).cast("double"), centres)
    return df.withColumn(out_col, rank_map_expr(lab, ranks))


def one_hot_classes(df: DataFrame, category_col: str = "category",
                    drop=("order_id", "product_id", "customer_unique_id", "geolocation_state",
                          "order_purchase_timestamp")) -> DataFrame:
    """Indicators ``category_high_value / _low_value / _mid_value`` over the fixed class
    vocabulary (a class absent from the data still gets its all-zero column); drops the
    class column and the identifier / time columns."""
    out = df.select("*", *one_hot(category_col, CATEGORIES, "category"))
    return out.drop(category_col, *[c for c in drop if c in out.columns])
