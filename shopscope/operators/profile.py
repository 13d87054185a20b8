"""Describe, quantiles, histograms, top values and column profiles.

Exact quantiles at scale
------------------------
Spark's ``percentile`` aggregate keeps every distinct value of a group in one buffer, and a
global quantile merges all of them in one task. ``quantiles`` instead:

1. reduces the column to (group, value, count) - a hot value collapses to one row,
2. range-partitions these rows by (group, value) and writes them down with their partition, so a
   large group is spread over many partitions and many small groups share one,
3. carries the counts of a group's earlier partitions into its later ones (a table of at most
   groups + partitions rows) and ranks values inside each (group, partition) with a running sum,
4. joins the wanted ranks floor(p(n-1)) and ceil(p(n-1)) to the partition that holds them and
   interpolates linearly (the definition of pandas ``quantile``, Spark ``percentile`` and
   DuckDB ``quantile_cont``).

No step holds more than one partition of one group's distinct values in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shopscope.session import materialize

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _drop_null_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group keys that are null form no group (pandas ``groupby`` semantics)."""
    for k in by:
        df = df.where(F.col(k).isNotNull())
    return df


def _window(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def value_hist(df: DataFrame, column: str, by: Sequence[str] = (),
               weight_col: str | None = None, keep_nulls: bool = False) -> DataFrame:
    """(*by, __x, __c): distinct values of ``column`` per group with their row count (or
    total weight). Partial aggregation runs before the shuffle, so a value that holds a
    large share of the rows costs one row per map task."""
    by = list(by)
    x = F.col(column).cast("double")
    wt = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    base = _drop_null_keys(df, by)
    if not keep_nulls:
        base = base.where(F.col(column).isNotNull())
    return base.groupBy(*by, x.alias("__x")).agg(F.sum(wt).alias("__c"))


def ranged(hist: DataFrame, by: Sequence[str] = (), values: Sequence[str] = ("__x",)) -> DataFrame:
    """A histogram written down in ranges of (group, value), with the range's number ``__b``.

    Range borders come from a sample and differ from run to run; written once, all readers agree."""
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(hist.repartitionByRange(parts, *by, *values).withColumn("__b", F.spark_partition_id()))


def quantiles_from_hist(hist: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles from a (*by, __x, __c) histogram, ``ranged`` or not (see module doc)."""
    by = list(by)
    plist = [float(p) for p in probs]
    hb = (hist if "__b" in hist.columns else ranged(hist, by)).where(F.col("__x").isNotNull())
    sizes = hb.groupBy(*by, "__b").agg(F.sum("__c").alias("__bc"))
    before = _window(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("p") * (F.col("__n") - 1)
    # the wanted ranks, each with the one bucket that holds it: at most 2 x probs rows a group
    wanted = (sizes.select(*by, "__b", "__bc",
                           F.coalesce(F.sum("__bc").over(before), F.lit(0)).alias("__off"),
                           F.sum("__bc").over(_window(by)).alias("__n"))
              .withColumn("p", F.explode(F.array(*[F.lit(p) for p in plist])))
              .withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))))
              .where((F.col("__rank") >= F.col("__off")) & (F.col("__rank") < F.col("__off") + F.col("__bc"))))
    running = Window.partitionBy(*by, "__b").orderBy("__x") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("__end") + F.col("__off")
    picked = (hb.withColumn("__end", F.sum("__c").over(running)).join(wanted, [*by, "__b"])
              .where((end - F.col("__c") <= F.col("__rank")) & (F.col("__rank") < end)))
    res = picked.groupBy(*by, "p").agg(
        F.max(F.when(F.col("__rank") == F.floor(pos), F.col("__x"))).alias("__vlo"),
        F.max(F.when(F.col("__rank") == F.ceil(pos), F.col("__x"))).alias("__vhi"),
        F.first("__n").alias("__n"))
    frac = pos - F.floor(pos)
    return res.select(*by, "p", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * frac).alias("value"))


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (),
              method: str = "exact", accuracy: int = 10000,
              weight_col: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles of ``column`` per group: columns ``*by, p, value``.

    ``method``: ``"exact"`` (distributed, see module doc), ``"percentile"`` (Spark's exact
    aggregate: fine for small groups) or ``"approx"`` (``percentile_approx``).
    ``weight_col`` (exact method only) gives each row an integer multiplicity, as if it
    were repeated that many times. The exact method evaluates ``df`` once: its histogram is
    written down before the ranking jobs read it.
    """
    by = list(by)
    plist = [float(p) for p in probs]
    if method in ("percentile", "approx"):
        if weight_col:
            raise ValueError("weights need method='exact'")
        base = (_drop_null_keys(df, by).where(F.col(column).isNotNull())
                .select(*by, F.col(column).cast("double").alias("__x")))
        arg = F.array(*[F.lit(p) for p in plist])
        agg = (F.percentile("__x", arg) if method == "percentile"
               else F.percentile_approx("__x", arg, accuracy))
        q = base.groupBy(*by).agg(agg.alias("__q"))
        return q.select(*by, F.posexplode("__q").alias("__i", "value")).select(
            *by, F.element_at(arg, F.col("__i") + 1).alias("p"), "value")
    if method != "exact":
        raise ValueError(method)
    return quantiles_from_hist(value_hist(df, column, by, weight_col), plist, by)


def _pname(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def quantiles_wide(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (),
                   method: str = "exact") -> DataFrame:
    """Quantiles as one column per probability (``p25``, ``p50`` ...), one row per group."""
    q = quantiles(df, column, probs, by, method)
    cols = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(_pname(p))
            for p in probs]
    return q.groupBy(*by).agg(*cols) if by else q.agg(*cols)


def _moments_from_hist(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, max per group from a (*by, __x, __c) histogram;
    the variance is a sum of squared deviations from the group mean (no cancellation)."""
    by = list(by)
    valid = hist.where(F.col("__x").isNotNull())
    first = valid.groupBy(*by).agg(
        F.sum("__c").alias("count"),
        (F.sum(F.col("__c") * F.col("__x")) / F.sum("__c")).alias("mean"),
        F.min("__x").alias("min"), F.max("__x").alias("max"))
    if by:
        dev = valid.join(first, by, "inner").groupBy(*by).agg(
            F.sum(F.col("__c") * (F.col("__x") - F.col("mean")) ** 2).alias("__ss"))
        out = first.join(dev, by, "inner")
    else:
        mean = first.select("mean").scalar()
        ss = valid.agg(F.sum(F.col("__c") * (F.col("__x") - mean) ** 2)).scalar()
        out = first.withColumn("__ss", ss)
    return out.withColumn("std", F.sqrt(F.col("__ss") / F.nullif(F.col("count") - 1, F.lit(0)))) \
        .drop("__ss")


def describe(df: DataFrame, column: str, by: Sequence[str] = (), method: str = "exact",
             weight_col: str | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear), max — per group when ``by``.

    Exact method: the input is reduced once to a value histogram (materialized); moments
    and quantiles are computed from it. ``weight_col`` (exact method only): integer
    multiplicity of each row.
    """
    by = list(by)
    if weight_col and method != "exact":
        raise ValueError("weights need method='exact'")
    if method == "exact":
        hist = ranged(value_hist(df, column, by, weight_col), by)
        moments = _moments_from_hist(hist, by)
        qs = quantiles_from_hist(hist, DESCRIBE_PROBS, by)
        qs = qs.groupBy(*by).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value")))
                                   .alias(_pname(p)) for p in DESCRIBE_PROBS])
    else:
        base = _drop_null_keys(df, by)
        x = F.col(column)
        moments = base.groupBy(*by).agg(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
        qs = quantiles_wide(base, column, DESCRIBE_PROBS, by, method)
    if by:
        out = moments.join(qs, by, "left")
    else:  # both one row: attach the quantiles as one struct-valued scalar subquery
        q = qs.select(F.struct(*[_pname(p) for p in DESCRIBE_PROBS])).scalar()
        out = moments.select("*", *[q.getField(_pname(p)).alias(_pname(p)) for p in DESCRIBE_PROBS])
    return out.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_by(df: DataFrame, column: str, by: str | Sequence[str], method: str = "exact") -> DataFrame:
    return describe(df, column, [by] if isinstance(by, str) else list(by), method)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max: ``bin, lo, hi, n``.

    x = max lands in the last bin (Spark's ``width_bucket`` would open an extra one).
    """
    x = F.col(column).cast("double")
    # min and max as one struct-valued scalar subquery (reused, so evaluated once)
    bounds = df.agg(F.struct(F.min(x).alias("mn"), F.max(x).alias("mx"))).scalar()
    mn, mx = bounds.getField("mn"), bounds.getField("mx")
    w = (mx - mn) / F.lit(float(bins))
    b = F.when(w > 0, F.least(F.floor((x - mn) / w), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = (df.where(F.col(column).isNotNull())
               .select(b.cast("int").alias("bin"), mn.alias("__mn"), mx.alias("__mx"))
               .groupBy("bin", "__mn", "__mx").agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("__mx") - F.col("__mn")) / F.lit(float(bins))
    return counted.select("bin", (F.col("__mn") + F.col("bin") * width).alias("lo"),
                          (F.col("__mn") + (F.col("bin") + 1) * width).alias("hi"),
                          "n").orderBy("bin")


def auto_bins(hist: DataFrame, max_bins: int = 1000) -> DataFrame:
    """One row (lo, width, bins) for the histogram of a ``ranged`` (__x, __c) histogram of values.

    The width is the narrower of Freedman-Diaconis, 2 * (p75 - p25) / n^(1/3), and Sturges,
    (max - min) / (log2(n) + 1); without an interquartile range Sturges holds. At most ``max_bins``."""
    q = quantiles_from_hist(hist, (0.25, 0.75)).agg((F.max("value") - F.min("value")).alias("iqr")).scalar()
    base = hist.where(F.col("__x").isNotNull()).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.sum("__c").alias("n"))
    n, extent = F.col("n").cast("double"), F.col("hi") - F.col("lo")
    sturges = extent / (F.log2(n) + 1)
    fd = F.lit(2.0) * F.col("iqr") * F.pow(n, F.lit(-1.0 / 3))
    width = F.when(F.col("iqr") > 0, F.least(fd, sturges)).otherwise(sturges)
    bins = F.when(extent > 0, F.least(F.ceil(extent / width), F.lit(max_bins))).otherwise(F.lit(1))
    return base.withColumn("iqr", q).select("lo", (extent / bins).alias("width"), bins.cast("int").alias("bins"))


def auto_histogram(df: DataFrame, column: str, weight_col: str | None = None, max_bins: int = 1000) -> DataFrame:
    """Histogram whose bins follow the data (``auto_bins``): ``bin, lo, hi, n``, empty bins left out.

    The input is reduced once to its distinct values; bin rule and counts are computed from those.
    ``weight_col``: integer multiplicity of each row. x = max lies in the last bin."""
    hist = ranged(value_hist(df, column, (), weight_col))
    rule = auto_bins(hist, max_bins).select(F.struct("lo", "width", "bins")).scalar()
    lo, width, bins = (rule.getField(c) for c in ("lo", "width", "bins"))
    b = F.when(width > 0, F.least(F.floor((F.col("__x") - lo) / width), bins - 1)).otherwise(F.lit(0))
    counted = hist.where(F.col("__x").isNotNull()).select(b.cast("int").alias("bin"), lo.alias("l"), width.alias("w"), "__c")         .groupBy("bin", "l", "w").agg(F.sum("__c").alias("n"))
    return counted.select("bin", (F.col("l") + F.col("bin") * F.col("w")).alias("lo"),
                          (F.col("l") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n").orderBy("bin")


def _long(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """(column, value) pairs, one per input row and column (an Expand, not a Generate)."""
    return (df.select(*[F.col(f"`{c}`").cast(cast).alias(c) for c in columns])
            .unpivot([], list(columns), "column", "value"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent non-null values of each column: ``column, value, n, rank``.

    Ties are broken by value. ``row_number() <= k`` lets Spark place a per-task group limit
    before the shuffle, so each column's partition holds at most k rows per map task.
    """
    counts = (_long(df, columns, "string").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .orderBy("column", "rank"))


def mode_of(df: DataFrame, column: str):
    """Most frequent non-null value (ties: smallest value), as a Python scalar or None."""
    row = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc(column)).limit(1).first())
    return None if row is None else row[0]


def profile(df: DataFrame, columns: Sequence[str] | None = None,
            method: str = "exact") -> DataFrame:
    """Per numeric column: n, n_null, null_pct, n_distinct, mean, std, min, max, p25/50/75.

    The columns are stacked into (column, value) pairs and reduced once to a histogram of
    (column, value, count), nulls included; every statistic is computed from it, so the
    input is evaluated once whatever the number of columns.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    long = _long(df, cols, "double")
    hist = ranged(value_hist(long, "value", ["column"], keep_nulls=True), ["column"])
    counts = hist.groupBy("column").agg(
        F.sum("__c").alias("rows"),
        F.sum(F.when(F.col("__x").isNull(), F.col("__c"))).alias("n_null"),
        F.count("__x").alias("n_distinct"))
    moments = _moments_from_hist(hist, ["column"])
    qs = quantiles_from_hist(hist, DESCRIBE_PROBS, ["column"]).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(_pname(p))
          for p in DESCRIBE_PROBS])
    n_null = F.coalesce(F.col("n_null"), F.lit(0))
    return (counts.join(moments, "column", "left").join(qs, "column", "left")
            .select("column", (F.col("rows") - n_null).alias("n"), n_null.alias("n_null"),
                    (F.lit(100.0) * n_null / F.col("rows")).alias("null_pct"),
                    "n_distinct", "mean", "std", "min", "max", "p25", "p50", "p75")
            .orderBy("column"))
