"""Time, geography and best-seller aggregates over the fact table.

All of them are one or two aggregations with partial (map-side) combine; the only values
brought to the driver are the k names of a top-k list that become pivot columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopscope.functions import period_label
from shopscope.operators.joins import lookup_join, semi_join


def value_counts(df: DataFrame, column: str, descending: bool = True,
                 count_name: str = "n") -> DataFrame:
    """Rows per non-null value, sorted by count (desc) or by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias(count_name))
    if descending:
        return out.orderBy(F.desc(count_name), F.asc(column))
    return out.orderBy(column)


def monthly_category_counts(df: DataFrame, categories: Sequence[str], year: int,
                            category_col: str = "category",
                            ts_col: str = "order_purchase_timestamp") -> DataFrame:
    """Rows per (category, month) within one year, for categories matched by substring.

    One aggregation for all categories (not one filtered frame each). The year test is a
    range on the timestamp, so it is pushed to the Parquet scan when the column is stored.
    A row matching several patterns is counted under each.
    """
    start = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp_ntz(F.lit(year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    in_year = df.where((F.col(ts_col) >= start) & (F.col(ts_col) < end))
    labels = F.array(*[F.when(F.col(category_col).contains(c), F.lit(c)) for c in categories])
    tagged = in_year.select(F.explode(labels).alias("category"),
                            F.month(ts_col).alias("month")).where(F.col("category").isNotNull())
    return (tagged.groupBy("category", "month").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("category", "month"))


def counts_by_state(df: DataFrame, state_col: str = "customer_state",
                    id_col: str = "customer_unique_id", descending: bool = False) -> DataFrame:
    """Non-null ``id_col`` rows per state (rows, not distinct customers)."""
    out = (df.where(F.col(state_col).isNotNull()).groupBy(F.col(state_col).alias("state"))
           .agg(F.count(id_col).alias("n")))
    return out.orderBy(F.desc("n") if descending else F.asc("n"), "state")


def state_bubbles(df: DataFrame, scale: float = 20.0, state_col: str = "customer_state",
                  id_col: str = "customer_unique_id", lat_col: str = "geolocation_lat",
                  lng_col: str = "geolocation_lng") -> DataFrame:
    """Map bubbles: rows per state, the state's centroid and radius = n * scale."""
    return (df.where(F.col(state_col).isNotNull()).groupBy(F.col(state_col).alias("state"))
            .agg(F.count(id_col).alias("n"), F.avg(lat_col).alias("lat"),
                 F.avg(lng_col).alias("lng"))
            .withColumn("radius", F.col("n").cast("double") * F.lit(float(scale)))
            .orderBy("n", "state"))


def best_sellers(df: DataFrame, k: int = 10, category_col: str = "product_category_name",
                 value_col: str = "price") -> DataFrame:
    """Top k categories by total value; ties broken by name (planned as TakeOrderedAndProject)."""
    totals = (df.where(F.col(category_col).isNotNull()).groupBy(category_col)
              .agg(F.coalesce(F.sum(value_col), F.lit(0.0)).alias("total")))
    return totals.orderBy(F.desc("total"), F.asc(category_col)).limit(k)


def pivot_sum(df: DataFrame, index: str, columns: str, values: str,
              column_values: Sequence[str] | None = None) -> DataFrame:
    """Pivot table with sum; an empty cell is null. Give ``column_values`` to skip the
    job that discovers them."""
    g = df.groupBy(index)
    p = g.pivot(columns, list(column_values)) if column_values is not None else g.pivot(columns)
    return p.agg(F.sum(values)).orderBy(index)


def best_seller_monthly(df: DataFrame, translation: DataFrame, k: int = 10,
                        ts_col: str = "order_purchase_timestamp", value_col: str = "price",
                        category_col: str = "product_category_name",
                        english_col: str = "product_category_name_english") -> DataFrame:
    """Monthly revenue (month of year, years merged) of the k best-selling categories,
    one column per category's English name.

    Two jobs: the top-k aggregate (k rows reach the driver: they name the pivot columns and
    become an ``IN`` list), then one pivot aggregation over the matching rows.
    """
    named = lookup_join(df, translation, category_col)
    top = best_sellers(named, k, category_col, value_col)
    top_rows = top.join(translation, category_col).select(category_col, english_col).collect()
    cats = [r[0] for r in top_rows]
    names = sorted(r[1] for r in top_rows)
    best = named.where(F.col(category_col).isin(cats))
    monthly = best.select(F.month(ts_col).alias("month"), english_col, value_col)
    return pivot_sum(monthly, "month", english_col, value_col, names)


def best_sellers_ranked(df: DataFrame, translation: DataFrame, k: int = 10,
                        value_col: str = "price", category_col: str = "product_category_name",
                        english_col: str = "product_category_name_english") -> DataFrame:
    """k rows: rank (1 = best), category and its English name."""
    top = best_sellers(lookup_join(df, translation, category_col), k, category_col, value_col)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), category_col)))  # k rows
    return ranked.join(translation.select(category_col, english_col), category_col) \
        .select("rank", category_col, english_col)


def best_seller_monthly_long(df: DataFrame, translation: DataFrame, k: int = 10,
                             ts_col: str = "order_purchase_timestamp", value_col: str = "price",
                             category_col: str = "product_category_name") -> DataFrame:
    """Monthly revenue of the k best-selling categories in long form: rank, category, month, total."""
    ranked = best_sellers_ranked(df, translation, k, value_col, category_col)
    members = best_seller_members(lookup_join(df, translation, category_col), k, category_col, value_col)
    monthly = members.groupBy(category_col, F.month(ts_col).alias("month")).agg(F.sum(value_col).alias("total"))
    return monthly.join(F.broadcast(ranked), category_col) \
        .select("rank", F.col("product_category_name_english").alias("category"), "month", "total")


def best_seller_monthly_ranked(df: DataFrame, translation: DataFrame, k: int = 10, **cols) -> DataFrame:
    """``best_seller_monthly`` with columns named by rank: month, top_01 ... (null: no sales)."""
    long = best_seller_monthly_long(df, translation, k, **cols)
    return long.groupBy("month").agg(*[
        F.sum(F.when(F.col("rank") == i, F.col("total"))).alias(f"top_{i:02d}") for i in range(1, k + 1)])


def best_seller_members(df: DataFrame, k: int = 10,
                        category_col: str = "product_category_name",
                        value_col: str = "price") -> DataFrame:
    """Rows whose category is among the k best sellers, as a left-semi join (no collect)."""
    return semi_join(df, best_sellers(df, k, category_col, value_col), category_col)


def orders_per_period(df: DataFrame, ts_col: str = "order_purchase_timestamp",
                      id_col: str = "order_id") -> DataFrame:
    """Rows with an order id per (year, month), with a ``M/YYYY`` label, in time order."""
    return (df.select(F.year(ts_col).alias("year"), F.month(ts_col).alias("month"), id_col)
            .groupBy("year", "month").agg(F.count(id_col).alias("n"))
            .withColumn("period", period_label("month", "year"))
            .orderBy("year", "month"))
