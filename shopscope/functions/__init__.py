"""Column expressions shared by the operators. All are built-in Spark expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, truncated (not calendar days).

    Taken from the day field of the (end - start) day-time interval: for timestamp_ntz no
    session time zone is involved, so a daylight-saving change cannot turn a day into 23
    or 25 hours.
    """
    return F.extract(F.lit("DAY"), col(end) - col(start)).cast("int")


def round_half_even(c: ColumnLike, digits: int = 2) -> Column:
    """Banker's rounding, as numpy rounds."""
    return F.bround(col(c), digits)


def safe_div(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, null when den is 0 or null (ANSI division would raise)."""
    return col(num) / F.nullif(col(den), F.lit(0))


def pct_error(actual: ColumnLike, predicted: ColumnLike) -> Column:
    """100 * |actual - predicted| / actual, null where actual is 0."""
    return safe_div(F.lit(100.0) * F.abs(col(actual) - col(predicted)), actual)


def score_class(score: ColumnLike, mid_above: int = 1, high_above: int = 3) -> Column:
    """Overall score -> value class: <= mid_above low, <= high_above mid, else high."""
    s = col(score)
    return (F.when(s > high_above, F.lit("high_value"))
            .when(s > mid_above, F.lit("mid_value"))
            .otherwise(F.lit("low_value")))


def one_hot(c: ColumnLike, vocabulary: Sequence[str], prefix: str) -> list[Column]:
    """One integer indicator per vocabulary entry, named ``{prefix}_{value}``."""
    return [(col(c) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in vocabulary]


def hash_bucket(*keys: ColumnLike, buckets: int = 100, salt: str = "") -> Column:
    """Stable bucket in [0, buckets) from the first 8 hex digits of md5(salt || keys)."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    if salt:
        text = F.concat(F.lit(salt), text)
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets))


def hash_order_key(*keys: ColumnLike, salt: str = "") -> Column:
    """Full md5 text used as a reproducible random order."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.md5(text)


def period_label(month: ColumnLike, year: ColumnLike) -> Column:
    """``"M/YYYY"``."""
    return F.concat_ws("/", col(month).cast("string"), col(year).cast("string"))


def bucket_by_edges(x: ColumnLike, edges: Sequence[float]) -> Column:
    """Index of the first edge >= x (0..len(edges)), as a balanced tree of comparisons.

    A nested CASE of depth log2(len(edges)) instead of a linear chain keeps the generated
    code small enough for whole-stage codegen with hundreds of edges.
    """
    xc = col(x)
    edges = list(edges)

    def build(lo: int, hi: int) -> Column:
        # result in [lo, hi]; edges[lo:hi] separate the candidates
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(xc <= F.lit(edges[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(edges))


def nearest_sorted_centre(x: ColumnLike, centres: Sequence[float]) -> Column:
    """Index of the nearest of ascending centres; a point on a midpoint goes to the lower one."""
    mids = [(centres[i] + centres[i + 1]) / 2.0 for i in range(len(centres) - 1)]
    return bucket_by_edges(x, mids)
