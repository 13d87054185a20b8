"""One-dimensional k-means on a weighted value histogram, cluster ranking, elbow curve.

The R, F, M and CLV clusterings are 1-D. Fitting on rows would cost one pass over the fact
table per iteration; instead each column is reduced once to its distinct values with a
weight (rows per value), which gives the same objective on far fewer rows. ``best_centres``
finds the exact optimum (``operators.optimal``) for all series and all k in the same few jobs.

``kmeans_1d`` is the plain Lloyd iteration from the (i + 0.5) / k quantiles of the distinct values: a
local optimum. ``kmeans_ml`` uses Spark ML ``KMeans`` (k-means|| start, ``weightCol``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopscope.functions import nearest_sorted_centre
from shopscope.operators.optimal import optimal_borders
from shopscope.operators.profile import quantiles_from_hist

# Guard on Lloyd iterations: a fit that hasn't converged by then raises.
LLOYD_MAX_ITER = 1000


def value_histogram(df: DataFrame, value_col: str, weight_col: str | None = None) -> DataFrame:
    """(value, weight): distinct non-null values and their total weight (rows by default)."""
    w = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    return (df.where(F.col(value_col).isNotNull())
            .groupBy(F.col(value_col).cast("double").alias("value"))
            .agg(w.cast("double").alias("weight")))


Fit = tuple  # (series or None, k)


def _normalize_fits(ks) -> list[Fit]:
    if isinstance(ks, int):
        return [(None, ks)]
    if isinstance(ks, dict):
        out = []
        for series, kk in ks.items():
            out += [(series, k) for k in ([kk] if isinstance(kk, int) else kk)]
        return out
    return [(None, k) for k in ks]


def initial_centres(hist: DataFrame, fits: Sequence[Fit],
                    series_col: str | None = None) -> dict[Fit, list[float]]:
    """(i + 0.5) / k quantiles of each series' distinct values (one quantile job)."""
    probs = sorted({(i + 0.5) / k for _, k in fits for i in range(k)})
    by = [series_col] if series_col else []
    q = {}
    # each histogram row is one distinct value (count 1 for quantiles of distinct values);
    # the histogram is cached by the caller, so it is ranked as it is
    distinct = hist.select(*by, F.col("value").alias("__x"), F.lit(1).cast("bigint").alias("__c"))
    for r in quantiles_from_hist(distinct, probs, by=by).collect():
        q[(r[series_col] if series_col else None, round(r["p"], 12))] = r["value"]
    return {(s, k): [q[(s, round((i + 0.5) / k, 12))] for i in range(k)] for s, k in fits}


def _assignments(fits: Sequence[Fit], centres: dict[Fit, list[float]],
                 series_col: str | None) -> Column:
    recs = []
    for i, f in enumerate(fits):
        lab = nearest_sorted_centre("value", centres[f])
        if series_col is not None:
            lab = F.when(F.col(series_col) == F.lit(f[0]), lab)
        recs.append(F.struct(F.lit(i).alias("fit"), lab.alias("cluster")))
    return F.array(*recs)


def kmeans_1d(hist: DataFrame, ks, max_iter: int = LLOYD_MAX_ITER, cache: bool = True,
              series_col: str | None = None) -> dict:
    """Ascending centres of the converged Lloyd iteration.

    ``ks``: an int, a list of ints, or (with ``series_col``) a dict series -> k or [k...].
    All fits advance together: one aggregation per iteration. Stops when no value changes its
    cluster: clusters are neighbouring ranges of values, so unchanged cluster weights decide that
    (sums of centres could differ in their last bits from run to run). Raises RuntimeError if
    that isn't reached in ``max_iter`` iterations. An empty cluster keeps its centre. Returns {k: centres} without ``series_col``, else
    {(series, k): centres}.
    """
    fits = _normalize_fits(ks)
    cols = ([series_col] if series_col else []) + ["value", "weight"]
    h = hist.select(*cols)
    if cache:
        h = h.cache()
    try:
        centres = initial_centres(h, fits, series_col)
        last = None
        for _ in range(max_iter):
            sums = (h.select("value", "weight", F.inline(_assignments(fits, centres, series_col)))
                    .where(F.col("cluster").isNotNull())
                    .groupBy("fit", "cluster")
                    .agg(F.sum(F.col("weight") * F.col("value")).alias("sw"),
                         F.sum("weight").alias("w"))
                    .collect())
            new = {f: list(c) for f, c in centres.items()}
            for r in sums:
                if r["w"]:
                    new[fits[r["fit"]]][r["cluster"]] = r["sw"] / r["w"]
            centres = new
            weights = {(r["fit"], r["cluster"]): r["w"] for r in sums if r["w"]}
            if weights == last:
                break
            last = weights
        else:
            raise RuntimeError(f"k-means hasn't converged after {max_iter} iterations")
    finally:
        if cache:
            h.unpersist()
    if series_col is None:
        return {k: c for (_, k), c in centres.items()}
    return centres


def best_centres(hist: DataFrame, ks, series_col: str | None = None) -> dict:
    """Ascending centres of the optimal clustering (least weighted sum of squares of all).

    Arguments and keys as in ``kmeans_1d``; ``hist`` is read once a round, so cache it. With fewer
    distinct values than k each value is a centre."""
    fits = _normalize_fits(ks)
    h = hist.select((F.col(series_col) if series_col else F.lit("")).alias("series"), "value", "weight")
    wanted: dict = {}
    for s, k in fits:
        wanted.setdefault("" if s is None else s, []).append(k)
    found = optimal_borders(h, wanted)
    if series_col is None:
        return {k: c for (_, k), (c, _) in found.items()}
    return {f: c for f, (c, _) in found.items()}


def assign(df: DataFrame, value_col: str, centres: Sequence[float], out_col: str) -> DataFrame:
    """Label each row with the index of its nearest centre."""
    return df.withColumn(out_col, nearest_sorted_centre(F.col(value_col).cast("double"),
                                                       list(centres)))


def sse(hist: DataFrame, centres: dict[int, list[float]]) -> DataFrame:
    """Within-cluster sum of squares per k: ``k, sse`` (one job for all k)."""
    ks = sorted(centres)
    recs = F.array(*[F.struct(
        F.lit(k).alias("k"),
        (F.col("weight") * F.pow(F.col("value") - F.element_at(
            F.array(*[F.lit(float(c)) for c in centres[k]]),
            nearest_sorted_centre("value", centres[k]) + 1), 2)).alias("d"))
        for k in ks])
    return (hist.select(F.inline(recs)).groupBy("k").agg(F.sum("d").alias("sse")).orderBy("k"))


def elbow(hist: DataFrame, ks: Sequence[int] = range(1, 8)) -> DataFrame:
    """Least SSE for each k: ``k, sse``."""
    h = hist.cache()
    try:
        return _materialize(sse(h, best_centres(h, list(ks))))
    finally:
        h.unpersist()


def _materialize(df: DataFrame) -> DataFrame:
    # k rows: bring them back as a small frame so the histogram cache can be released
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema)


def cluster_ranks(df: DataFrame, cluster_col: str, target_col: str,
                  ascending: bool = True, weight_col: str | None = None) -> DataFrame:
    """k-row map cluster -> rank of the cluster's mean target (0-based; ties by cluster id)."""
    if weight_col:
        mean = F.sum(F.col(weight_col) * F.col(target_col)) / F.sum(weight_col)
    else:
        mean = F.avg(target_col)
    means = df.groupBy(cluster_col).agg(mean.alias("__mean"))
    order = F.asc("__mean") if ascending else F.desc("__mean")
    w = Window.orderBy(order, F.asc(cluster_col))  # k rows
    return means.select(cluster_col, (F.row_number().over(w) - 1).alias("__rank"))


def order_cluster(df: DataFrame, cluster_col: str, target_col: str, ascending: bool = True,
                  weight_col: str | None = None) -> DataFrame:
    """Replace cluster ids by the rank of their mean target (k-row broadcast map)."""
    ranks = cluster_ranks(df, cluster_col, target_col, ascending, weight_col)
    out = df.join(F.broadcast(ranks), cluster_col, "inner").drop(cluster_col)
    return out.withColumnRenamed("__rank", cluster_col)


def kmeans_ml(df: DataFrame, value_col: str, k: int, weight_col: str | None = None,
              max_iter: int = 1000, seed: int = 1) -> list[float]:
    """Spark ML k-means (k >= 2) on one column; returns ascending centres."""
    vec = VectorAssembler(inputCols=[value_col], outputCol="__v", handleInvalid="error") \
        .transform(df.select(F.col(value_col).cast("double").alias(value_col),
                             *([weight_col] if weight_col else [])))
    km = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="__v",
                weightCol=weight_col) if weight_col else \
        KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="__v")
    return sorted(float(c[0]) for c in km.fit(vec).clusterCenters())
