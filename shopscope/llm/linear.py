"""Logistic regression on hashed sparse rows: fitted on a bounded sample, then calibrated.

The sample is bounded in rows and in bytes of text (``bounded_sample``), and the driver gets of it only the
features that say something about the label (``telling_features`` counts them in Spark), as int32 and
float32. Scoring, which covers all rows, happens in the operators' Arrow batches. Everything is
deterministic: rows are chosen and divided by hashes of their ids, and the solver starts at zero.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopscope.llm.common import staged, tidy

SAMPLE_SCHEMA = "doc_id long, label int, idx binary, val binary"


@dataclass
class Model:
    """P(label 1) = sigmoid(a * (x . weight + bias) + c). Not fitted: a constant, which says nothing of a document."""

    weight: np.ndarray
    bias: float
    a: float
    c: float
    fitted: bool = True

    def probability(self, dot: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * (dot + self.bias) + self.c)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents: (doc_id, label, text), those with the least hashes of doc_id.

    Unlabelled rows and labels other than 0 and 1 are left out; of contradicting labels the greatest
    counts. The chosen ids (16 bytes each) are broadcast."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")) \
        .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def bounded_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, most_bytes: int) -> DataFrame:
    """The labelled sample as a table, cut to ``most_bytes`` bytes of text: rows in the order of their
    hashes as far as the sum allows; a row with more than a sixteenth of it is left out."""
    found = staged(labelled_sample(docs, labels, column, rows)
                   .withColumn("row_key", F.xxhash64("doc_id", "text")), "labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "row_key")  # at most ``rows`` labelled ids
    sizes = found.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("size")).where(F.col("size") <= most_bytes // 16)
    kept = sizes.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= most_bytes).select("row_key").distinct()
    return found.join(kept, "row_key", "left_semi").drop("row_key")


def telling_features(sample: DataFrame, features, least: float, most: int) -> np.ndarray:
    """At most ``most`` feature numbers whose rows have an unlikely share of label 1 (Chernoff: a share as far
    off has a probability of exp(-least) at most if the feature says nothing), the least likely first.

    Rows are counted for each feature by the tasks and summed by Spark."""
    def run(batches):
        for b in batches:
            labels, at = b.column("label").to_numpy(zero_copy_only=False), 0
            for rows in features(b):  # a slice of the batch at a time
                y = np.repeat(labels[at:at + len(rows)], [len(i) for i, _ in rows])
                at += len(rows)
                used, place = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.bincount(place, minlength=len(used))),
                     pa.array(np.bincount(place, y, minlength=len(used)).astype(np.int64))], names=["f", "n", "ones"])

    total = sample.agg(F.avg("label").alias("q")).first()["q"]
    if total is None:
        return np.zeros(0, np.int64)
    q = float(np.clip(total, 1e-9, 1 - 1e-9))
    counted = sample.select("doc_id", "label", "text").mapInArrow(tidy(run), "f int, n long, ones long") \
        .groupBy("f").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("ones") / F.col("n")))
    far = F.col("n") * (p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)))
    best = counted.select("f", far.alias("far")).where(F.col("far") >= least).orderBy(F.desc("far"), "f").limit(most)
    return np.sort(np.array([r["f"] for r in best.collect()], dtype=np.int64))


def collected(sample: DataFrame, features, wanted: np.ndarray | None = None
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, indptr, idx, val) of the sample, in the order of ids. ``features`` yields the (idx, val)
    arrays of a batch's rows a slice at a time; of these only the ``wanted`` ones (default: all) are sent."""
    def run(batches):
        for b in batches:
            at = 0
            for rows in features(b):
                if wanted is not None:
                    rows = [(i[k], v[k]) for i, v in rows for k in [np.isin(i, wanted)]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(rows)), b.column("label").slice(at, len(rows)),
                     pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()),
                     pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                    names=["doc_id", "label", "idx", "val"])
                at += len(rows)

    got = sample.mapInArrow(tidy(run), SAMPLE_SCHEMA).toArrow()
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending"), ("idx", "ascending")]))
    idx = [np.frombuffer(x.as_buffer(), np.int32) for x in got["idx"]]
    val = [np.frombuffer(x.as_buffer(), np.float32) for x in got["val"]]
    indptr = np.concatenate(([0], np.cumsum([len(x) for x in idx], dtype=np.int64)))
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return (got["doc_id"].to_numpy(), got["label"].to_numpy().astype(np.float64), indptr.astype(np.int64),
            join(idx, np.int32), join(val, np.float32))


def informative(y, indptr, idx, least: float) -> np.ndarray:
    """Features whose rows have an unlikely share of label 1: by Chernoff's bound, a share as far off
    has a probability of exp(-least) at most if the feature says nothing about the label."""
    row_of = np.repeat(np.arange(len(y)), np.diff(indptr))
    used, col = np.unique(idx, return_inverse=True)
    n = np.bincount(col, minlength=len(used))
    p = np.clip(np.bincount(col, y[row_of], minlength=len(used)) / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    q = np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9)
    return used[n * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))) >= least]


def only(features, indptr, idx, val):
    """The sample restricted to some features."""
    keep = np.isin(idx, features)
    kept = np.concatenate(([0], np.cumsum(keep)))
    return kept[indptr], idx[keep], val[keep]


def fit(ids, y, indptr, idx, val, dim: int, l2: float = 1e-6, steps: int = 120, rate: float = 0.2,
        swaps: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, swap_penalty: float = 1.0) -> Model:
    """Full-batch Adam on four fifths of the rows, Platt scaling on the rest.

    ``swaps``: (feature taken out, feature put in, times): the objective gets
    swap_penalty * sum(times * (weight in - weight out)**2) / rows, the squared change of the score
    under each swap. Without rows of both labels, or with less than ten, the model is the constant share of label 1 and not ``fitted``."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    constant = Model(np.zeros(dim, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0, fitted=False)
    if n < 10 or not 0 < y.sum() < n:
        return constant
    rest = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in ids])
    train = ~rest if 0 < y[~rest].sum() < (~rest).sum() else np.ones(n, bool)
    row_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))
    used = np.unique(idx)
    col = np.searchsorted(used, idx).astype(np.int32)
    w, b = np.zeros(len(used)), constant.bias
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    in_train = train[row_of]
    tc, tv, tr = col[in_train], val[in_train], row_of[in_train]
    if swaps is not None:
        near = [np.searchsorted(used, x) for x in swaps[:2]]
        known = np.ones(len(swaps[0]), bool)
        for at, x in zip(near, swaps[:2]):
            known &= (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == x)
        out, into, times = near[0][known], near[1][known], swaps[2][known].astype(np.float64)
    rows = train.sum()
    for step in range(1, steps + 1):
        z = np.bincount(tr, tv * w.astype(np.float32)[tc], minlength=n) + b
        err = np.where(train, sigmoid(z) - y, 0.0) / rows
        g = np.bincount(tc, tv * err.astype(np.float32)[tr], minlength=len(used)) + 2 * l2 * w
        if swaps is not None and len(out):
            change = 2 * swap_penalty * times * (w[into] - w[out]) / rows
            g += np.bincount(into, change, minlength=len(used)) - np.bincount(out, change, minlength=len(used))
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    z = np.bincount(row_of, val * w[col], minlength=n) + b
    a, c = platt(z[rest], y[rest]) if rest.any() else (1.0, 0.0)
    full = np.zeros(dim, np.float32)
    full[used] = w
    return Model(full, float(b), a, c)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, c) of sigmoid(a z + c) for held-out scores, with Platt's smoothed targets; a stays positive."""
    ones = y.sum()
    if not 0 < ones < len(y):
        return 1.0, 0.0
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + c)
        d, h = p - t, np.maximum(p * (1 - p), 1e-12)
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        move = np.linalg.solve(hess, g)
        a, c = max(1e-3, a - float(np.clip(move[0], -1, 1))), c - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(c)
