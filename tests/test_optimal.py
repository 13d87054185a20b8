"""The exact one-dimensional clustering against dynamic programming over all values."""

import numpy as np
import pytest

from shopscope.operators import cluster, optimal


def brute(value, weight, k):
    """Least sum of squares of k ranges of ascending values."""
    n = len(value)
    m = np.average(value, weights=weight)
    w, s, q = (np.concatenate(([0], np.cumsum(x))) for x in (weight, weight * (value - m), weight * (value - m) ** 2))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    for _ in range(min(k, n)):
        new = np.full(n + 1, np.inf)
        for i in range(1, n + 1):
            a = np.arange(i)
            new[i] = (best[:i] + q[i] - q[a] - (s[i] - s[a]) ** 2 / (w[i] - w[a])).min()
        best = new
    return best[n]


def series():
    rng = np.random.default_rng(5)
    yield "days", np.arange(0, 700, 1.0), rng.integers(1, 30, 700)
    yield "heavy", np.unique(np.round(rng.pareto(1.1, 900) * 100, 2)), None
    yield "gaps", np.unique(np.concatenate((rng.normal(0, 1, 200), rng.normal(1e6, 1e-3, 200), rng.normal(-50, 5, 200)))), None
    yield "few", np.array([1.0, 2.0, 50.0]), np.array([5, 1, 1])
    yield "one", np.array([7.25]), np.array([9])
    yield "ties", np.arange(0, 40, 1.0), np.ones(40)


@pytest.mark.parametrize("cells, stretches", [(2048, 64), (8, 64), (16, 2)])
def test_centres_reach_the_optimum(spark, monkeypatch, cells, stretches):
    monkeypatch.setattr(optimal, "CELLS", cells)
    monkeypatch.setattr(optimal, "STRETCHES", stretches)
    data = {n: (v, np.ones(len(v)) if w is None else w.astype(float)) for n, v, w in series()}
    hist = spark.createDataFrame([(n, float(v), float(w)) for n, (vs, ws) in data.items() for v, w in zip(vs, ws)],
                                 "series string, value double, weight double").cache()
    found = optimal.optimal_borders(hist, {n: list(range(1, 8)) for n in data})
    for (name, k), (centres, sse) in found.items():
        v, w = data[name]
        want = brute(v, w, k)
        total = brute(v, w, 1)
        assert len(centres) == min(k, len(v)) and centres == sorted(centres)
        assert sse <= want + 1e-9 * max(total, 1)
        nearest = np.abs(v[:, None] - np.array(centres)[None]).min(axis=1)
        assert (w * nearest ** 2).sum() <= want + 1e-9 * max(total, 1)
    assert set(found) == {(n, k) for n in data for k in range(1, 8)}


def test_best_is_no_worse_than_lloyd(spark):
    rng = np.random.default_rng(11)
    rows = [(float(v), 1.0) for v in np.unique(np.round(rng.lognormal(3, 1.5, 2000), 3))]
    hist = spark.createDataFrame(rows, "value double, weight double").cache()
    best = cluster.sse(hist, cluster.best_centres(hist, [3, 5])).collect()
    local = cluster.sse(hist, cluster.kmeans_1d(hist, [3, 5])).collect()
    assert all(b["sse"] <= a["sse"] * (1 + 1e-12) for a, b in zip(local, best))
