"""Profile of every column, whatever its type: missing and distinct values, extremes, moments, quartiles, top values.

The columns are stacked once into (column, number, text) rows: numbers as doubles, dates and timestamps as
text and as microseconds, everything else as text; NaN counts as missing.

* ``profile_columns`` (exact): the stack is reduced to one row for each different value of a column and
  written down in ranges of (column, value); counts, moments, quartiles and top values are computed from that
  table, so the input is read once.
* ``profile_sketch`` (mergeable): one aggregation keeps a fixed-size state for each column: counts, power
  sums, extremes, a HyperLogLog sketch of distinct values and a heavy-hitter sketch. States of further files
  or days are merged by ``merge_sketches`` without reading the old rows again; ``sketch_report`` reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopscope.functions import safe_div
from shopscope.operators.profile import DESCRIBE_PROBS, _moments_from_hist, _pname, quantiles_from_hist, ranged

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(t: T.DataType) -> str:
    """``number``, ``time`` or ``text``."""
    return "number" if isinstance(t, T.NumericType) else "time" if isinstance(t, _TIMES) else "text"


def _variant(field: T.StructField) -> tuple[Column, Column]:
    """(number, text) of a column; both null for a missing value."""
    c = F.col(f"`{field.name}`")
    kind = kind_of(field.dataType)
    if kind == "number":
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.cast("double"), F.lit(None).cast("string")
    if kind == "time":
        whole = c.cast("timestamp_ntz")
        return (F.lit(None).cast("double"),
                F.date_format(whole, "yyyy-MM-dd" if isinstance(field.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(field.dataType, T.BinaryType):
        return F.lit(None).cast("double"), F.hex(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.lit(None).cast("double"), F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    return F.lit(None).cast("double"), c.cast("string")


def stacked(df: DataFrame, columns: Sequence[str] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """(*extra, column, number, text): one row for each row and column of ``df``."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), *[v.alias(n) for v, n in zip(_variant(f), ("number", "text"))])
                     for f in fields])
    return df.select(*extra, F.inline(rows))


def _types(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), kind_of(f.dataType), i) for i, f in enumerate(df.schema.fields)
            if columns is None or f.name in columns]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, kind string, position int")


def _number_text(c: Column) -> Column:
    """A number as plain decimal text (six digits after the point)."""
    return c.cast("decimal(38,6)").cast("string")


def _shape(parts: DataFrame) -> DataFrame:
    return parts.select(
        "column", "dtype", "n", "n_null", safe_div(F.lit(100.0) * F.col("n_null"), F.col("n") + F.col("n_null")).alias("null_pct"),
        "n_distinct", "mean", "std", "min", "max", *[c for c in parts.columns if c in map(_pname, DESCRIBE_PROBS)],
        "min_text", "max_text", "top").orderBy("position")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """One row a column: column, dtype, n, n_null, null_pct, n_distinct, mean, std, min, max, p25, p50, p75
    (numbers), min_text, max_text (other types), top: array of (value, n), most frequent first, ties by value.

    Every statistic is exact. A frame without rows gives n 0 and no statistics; null_pct is null."""
    by = ["column"]
    hist = stacked(df, columns).groupBy("column", F.col("number").alias("__x"), F.col("text").alias("__t")) \
        .agg(F.count(F.lit(1)).alias("__c"))
    hist = ranged(hist, by, ("__x", "__t"))
    value = F.coalesce(_number_text(F.col("__x")), F.col("__t"))
    some = value.isNotNull()
    counts = hist.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(some, F.col("__c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~some, F.col("__c"))), F.lit(0)).alias("n_null"),
        F.count(F.when(some, 1)).alias("n_distinct"), F.min("__t").alias("min_text"), F.max("__t").alias("max_text"))
    numbers = hist.where("__x is not null")
    moments = _moments_from_hist(numbers, by).drop("count")
    quartiles = quantiles_from_hist(numbers, DESCRIBE_PROBS, by).groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(_pname(p)) for p in DESCRIBE_PROBS])
    place = Window.partitionBy(*by).orderBy(F.desc("__c"), F.asc("value"))
    best = hist.where(some).select("column", value.alias("value"), "__c").withColumn("place", F.row_number().over(place)) \
        .where(F.col("place") <= top).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "value", F.col("__c").alias("n")))).alias("l"))
    best = best.select("column", F.transform("l", lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n"))).alias("top"))
    out = _types(df, columns).join(counts, by, "left").join(moments, by, "left").join(quartiles, by, "left").join(best, by, "left")
    return _shape(out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "n_null", "n_distinct")}))


# ---------------------------------------------------------------- mergeable states

def profile_sketch(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), tracked: int = 1000) -> DataFrame:
    """One state of fixed size for each column (and group ``by``, for instance a day): a single aggregation
    with map-side combine. ``tracked``: values that the heavy-hitter sketch follows."""
    value = F.coalesce(_number_text(F.col("number")), F.col("text"))
    rows = stacked(df, columns, [F.col(c) for c in by]).withColumn("value", value)
    return rows.groupBy(*by, "column").agg(
        F.count("value").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
        F.sum("number").alias("s1"), F.var_pop("number").alias("v"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.hll_sketch_agg("value", 14).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {int(tracked)})").alias("heavy"))


def merge_sketches(*states: DataFrame) -> DataFrame:
    """One state for each column from states of any number of tables (groups are merged too)."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    n, mean = F.col("n"), F.col("s1") / F.nullif(F.col("n"), F.lit(0))
    total = rows.groupBy("column").agg((F.sum("s1") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    merged = rows.join(total, "column").groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.sum("s1").alias("s1"),
        (F.sum(n * (F.col("v") + (mean - F.col("m")) ** 2)) / F.nullif(F.sum("n"), F.lit(0))).alias("v"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr("approx_top_k_combine(heavy)").alias("heavy"))
    return merged


def sketch_report(state: DataFrame, like: DataFrame, top: int = 5) -> DataFrame:
    """The columns of ``profile_columns`` (without quartiles) from states; n_distinct and top are estimates.

    ``like``: a frame with the profiled columns, for their types."""
    n = F.col("n")
    rows = state.select(
        "column", "n", "n_null", F.hll_sketch_estimate("distinct").alias("n_distinct"),
        (F.col("s1") / F.nullif(n, F.lit(0))).alias("mean"),
        F.sqrt(F.col("v") * n / F.nullif(n - 1, F.lit(0))).alias("std"), "min", "max", "min_text", "max_text",
        F.transform(F.expr(f"approx_top_k_estimate(heavy, {int(top)})"),
                    lambda r: F.struct(r["item"].alias("value"), r["count"].alias("n"))).alias("top"))
    return _shape(_types(like, None).join(rows, "column"))
