"""Cleaning of the joined fact table (suffix resolution, sparse columns and rows, mode fill).

The column set after cleaning depends on the data. It is found with two small jobs whose
results are a handful of scalars: the null fraction of every column (one aggregation for
all columns) and the mode of the fill column. Everything else stays a lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def drop_suffixed(df: DataFrame, suffix: str = "_x") -> DataFrame:
    """Drop every column whose name ends with ``suffix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith(suffix)])


def strip_suffix(df: DataFrame, suffix: str = "_y") -> DataFrame:
    """Remove ``suffix`` from the names that end with it."""
    ren = {c: c[: -len(suffix)] for c in df.columns if c.endswith(suffix)}
    return df.withColumnsRenamed(ren) if ren else df


def null_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Fraction of nulls per column, from one aggregation over the frame."""
    cols = list(columns) if columns is not None else df.columns
    if not cols:
        return {}
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in cols}


def null_fraction_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The null fractions as a long frame ``column, null_fraction`` (lazy)."""
    cols = list(columns) if columns is not None else df.columns
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_fraction"))
                      for c in cols])
    return wide.select(F.inline(pairs))


def fill_strings(df: DataFrame, value: str) -> DataFrame:
    """Fill nulls of string columns only (numeric nulls stay null)."""
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.na.fill(value, subset=str_cols) if str_cols else df


def null_pattern_counts(df: DataFrame, columns: Sequence[str], mode_col: str | None) -> DataFrame:
    """Rows per (value of ``mode_col``, null pattern): the pattern is a bitmask with bit i
    set when ``columns[i]`` is null (up to 62 columns per mask word; more use several).

    One aggregation over the input answers both data-dependent questions of ``clean``:
    the null fraction of every column, and the mode of ``mode_col`` among the rows that
    survive any row-dropping rule defined on nulls.
    """
    words = []
    for w in range(0, len(columns), 62):
        expr = F.lit(0).cast("bigint")
        for i, c in enumerate(columns[w:w + 62]):
            expr = expr.bitwiseOR(F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i).cast("bigint"))
                                  .otherwise(F.lit(0).cast("bigint")))
        words.append(expr.alias(f"__m{w // 62}"))
    key = [F.col(f"`{mode_col}`").cast("string").alias("__v")] if mode_col else [F.lit(None).cast("string").alias("__v")]
    return df.select(*key, *words).groupBy("__v", *[f"__m{i}" for i in range(len(words))]) \
        .agg(F.count(F.lit(1)).alias("__n"))


def _is_null(columns: Sequence[str], c: str) -> F.Column:
    i = list(columns).index(c)
    return (F.col(f"__m{i // 62}").bitwiseAND(F.lit(1 << (i % 62)).cast("bigint")) != 0)


def clean(df: DataFrame, max_null: float = 0.5, drop_row_null: float = 0.05,
          mode_col: str | None = "lead_behaviour_profile") -> DataFrame:
    """The fact-table cleaning step.

    1. drop ``*_x`` columns and strip ``_y`` from the rest,
    2. drop columns whose null fraction is >= ``max_null``,
    3. drop rows with a null in any column whose null fraction is in (0, ``drop_row_null``),
    4. fill the remaining string nulls with the mode of ``mode_col`` (ties: smallest value).

    The input is aggregated once into (mode value, null pattern) counts, cached; the
    fractions and the mode after step 3 are small jobs on that table. The fractions of
    step 3 are those measured in step 2.
    """
    out = strip_suffix(drop_suffixed(df, "_x"), "_y")
    cols = out.columns
    mc = mode_col if mode_col in cols else None
    patterns = null_pattern_counts(out, cols, mc).cache()
    try:
        totals = patterns.agg(F.sum("__n").alias("rows"),
                              *[F.sum(F.when(_is_null(cols, c), F.col("__n")).otherwise(0))
                                .alias(f"__z{i}") for i, c in enumerate(cols)]).first()
        rows = totals["rows"] or 0
        fr = {c: ((totals[f"__z{i}"] or 0) / rows if rows else 0.0) for i, c in enumerate(cols)}
        keep = [c for c in cols if fr[c] < max_null]
        sparse = [c for c in keep if 0 < fr[c] < drop_row_null]
        m = None
        if mc is not None and mc in keep:
            survivors = patterns
            for c in sparse:
                survivors = survivors.where(~_is_null(cols, c))
            top = (survivors.where(F.col("__v").isNotNull()).groupBy("__v")
                   .agg(F.sum("__n").alias("n")).orderBy(F.desc("n"), F.asc("__v")).limit(1).first())
            m = None if top is None else top["__v"]
    finally:
        patterns.unpersist()
    res = out.select(*[F.col(f"`{c}`") for c in keep])
    if sparse:
        res = res.na.drop("any", subset=sparse)
    if m is not None:
        res = fill_strings(res, str(m))
    return res
