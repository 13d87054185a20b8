"""Join operators.

Strategy notes (large data):
* Equi joins are left to AQE: it turns a sort-merge join into a broadcast hash join only when
  the runtime size of one side is under ``spark.sql.autoBroadcastJoinThreshold``, so the size
  check is Spark's own and the fallback is the shuffle join. Explicit ``broadcast`` hints are
  used only for inputs whose size is fixed by construction (k-row maps, one-row aggregates).
* Skewed keys on the large side are split by AQE's skew-join handling.
* Aggregates that are attached back to detail rows are computed with ``groupBy`` (partial
  aggregation before the shuffle, so a hot key costs one row per map task) and joined back,
  never with a window that would put one key's rows into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def equi_condition(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                   right_on: Sequence[str], null_safe: bool = False) -> Column:
    cond = None
    for lk, rk in zip(left_on, right_on):
        c = left[lk].eqNullSafe(right[rk]) if null_safe else left[lk] == right[rk]
        cond = c if cond is None else cond & c
    return cond


def join_with_suffixes(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                       how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"),
                       null_safe: bool = False) -> DataFrame:
    """Join on same-named keys; other names present on both sides get ``_x`` / ``_y``.

    Key columns appear once. With ``null_safe`` null keys match each other (as in pandas).
    """
    keys = _keys(on)
    overlap = (set(left.columns) & set(right.columns)) - set(keys)
    lren = {c: c + suffixes[0] for c in overlap}
    rren = {c: c + suffixes[1] for c in overlap}
    lft = left.withColumnsRenamed(lren) if lren else left
    rgt = right.withColumnsRenamed(rren) if rren else right
    if not null_safe:
        return lft.join(rgt, keys, how)
    rk = {k: f"__r_{k}" for k in keys}
    rgt = rgt.withColumnsRenamed(rk)
    joined = lft.join(rgt, equi_condition(lft, rgt, keys, list(rk.values()), True), how)
    if how in ("inner", "left", "left_outer"):
        return joined.drop(*rk.values())
    out = joined
    for k, r in rk.items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.col(r))).drop(r)
    return out


def join_on(left: DataFrame, right: DataFrame, left_on: str | Sequence[str],
            right_on: str | Sequence[str], how: str = "inner",
            null_safe: bool = False) -> DataFrame:
    """Join on differently named keys; both key columns are kept."""
    lk, rk = _keys(left_on), _keys(right_on)
    return left.join(right, equi_condition(left, right, lk, rk, null_safe), how)


def lookup_join(df: DataFrame, lookup: DataFrame, on: str | Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join a dimension lookup (inner by default: unmatched and null keys are dropped).

    No broadcast hint: AQE broadcasts the lookup when its measured size allows it.
    """
    return df.join(lookup, _keys(on), how)


def semi_join(df: DataFrame, keys_df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_df`` (membership test)."""
    return df.join(keys_df.select(*_keys(on)), _keys(on), "left_semi")


def fanout_pair_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       key_name: str = "key") -> DataFrame:
    """Per key, the rows a many-to-many equi join produces: n_left * n_right.

    Each side is reduced to one count per key before the join, so the size of the
    exchange is the number of distinct keys, not the size of the cross product, and a key
    holding a large share of either side costs nothing extra.
    """
    lc = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias(key_name)) \
        .agg(F.count(F.lit(1)).alias("n_left"))
    rc = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias(key_name)) \
        .agg(F.count(F.lit(1)).alias("n_right"))
    return lc.join(rc, key_name).withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def attach_group_aggregates(df: DataFrame, keys: str | Sequence[str],
                            aggregates: dict[str, Column], drop_null_keys: bool = True) -> DataFrame:
    """Aggregate per key and attach the results to every detail row of that key.

    ``groupBy`` + join (not a window): partial aggregation happens before the shuffle and
    the join's large side can be split by AQE if one key is hot. Rows with a null key are
    dropped, as a pandas groupby + merge drops them.
    """
    ks = _keys(keys)
    base = df
    if drop_null_keys:
        cond = None
        for k in ks:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        base = df.where(cond)
    agg = base.groupBy(*ks).agg(*[c.alias(n) for n, c in aggregates.items()])
    return base.join(agg, ks, "inner")
