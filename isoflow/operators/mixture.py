"""Gaussian mixtures of several covariance families, and k-means by exchange.

Points stay where they are; a pass over them sends back sums, a few numbers for each cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import kept
from .cluster import canonical_labels, kmeans

#: Covariances: one number, one for each axis, one matrix for all clusters, one for each.
FAMILIES = ("spherical", "diagonal", "tied", "full")
#: Share of the mean variance that is added to every axis.
RIDGE = 1e-6


def rows_of(b: pa.RecordBatch, column: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def summed(points: DataFrame, f) -> np.ndarray:
    """``f(batch)``, an array, added up over all batches; a row for each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = f(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    rows = points.mapInArrow(run, "x binary").collect()
    return sum((np.frombuffer(r.x) for r in rows), np.zeros(1)) if rows else np.zeros(0)


def covariances(family: str, n: np.ndarray, s: np.ndarray, ridge: float) -> np.ndarray:
    """The family's covariances (k, d, d) from clusters' sizes and own covariances ``s``."""
    d = s.shape[1]
    eye = np.eye(d)
    if family == "spherical":
        s = np.trace(s, axis1=1, axis2=2)[:, None, None] / d * eye
    elif family == "diagonal":
        s = s * eye
    elif family == "tied":
        s = np.broadcast_to((n[:, None, None] * s).sum(axis=0) / n.sum(), s.shape)
    return s + ridge * eye


def parameters(family: str, k: int, d: int) -> int:
    """Free numbers of a mixture of the family."""
    own = {"spherical": k, "diagonal": k * d, "tied": d * (d + 1) // 2, "full": k * d * (d + 1) // 2}[family]
    return k - 1 + k * d + own


def log_shares(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(rows, k): log of weight times density."""
    out = np.empty((len(x), len(weight)))
    for c in range(len(weight)):
        low = np.linalg.cholesky(cov[c])
        z = np.linalg.solve(low, (x - mean[c]).T)
        out[:, c] = np.log(weight[c]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def responsibilities(x: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (rows, k) and log likelihoods of rows."""
    logs = log_shares(x, *model)
    top = logs.max(axis=1)
    total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    return np.exp(logs - total[:, None]), total


def mixture(points: DataFrame, k: int, families: tuple[str, ...] = FAMILIES, seed: int = 0, max_iter: int = 100, tolerance: float = 1e-7) -> tuple[DataFrame, str, dict[str, float]]:
    """(id, cluster, uncertainty) of ``points(id, v)``, the family chosen, and the BIC of every family.

    Expectation maximisation from a k-means start; all families go on in the same passes until
    the log likelihood of each rises by less than ``tolerance`` of itself. The family with the
    largest 2 log L - p log n is taken, the one with fewer parameters on ties. Labels are canonical;
    uncertainty is 1 minus the largest posterior. A cluster that would hold less than one
    point keeps its last mean and covariance. No points give no rows and no family.
    """
    if points.isEmpty():
        return points.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("uncertainty")), "", {}
    start = kmeans(points, k, starts=3, seed=seed)
    own = kept(points.join(start, "id").select("id", F.col("v").cast("array<double>").alias("v"), F.col("cluster").cast("int").alias("cluster")))
    d = own.select(F.size("v")).first()[0]
    # Numbers near the middle lose less in sums of squares.
    first = summed(own, lambda b: np.append(rows_of(b, 1).sum(axis=0), b.num_rows))
    middle, count = first[:-1] / first[-1], int(round(first[-1]))

    def moments(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x, optimize=True).ravel()])

    def unpacked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = s[:k], s[k : k + k * d].reshape(k, d)
        mean = m / np.maximum(n, 1e-300)[:, None]
        return n, mean, s[k + k * d :].reshape(k, d, d) / np.maximum(n, 1e-300)[:, None, None] - mean[:, :, None] * mean[:, None, :]

    def hard(b: pa.RecordBatch) -> np.ndarray:
        return moments(rows_of(b, 1) - middle, np.eye(k)[b.column(2).to_numpy() - 1])

    n, mean, s = unpacked(summed(own, hard))
    ridge = RIDGE * max(float(np.trace((n[:, None, None] * s).sum(axis=0))) / (count * d), 1e-12)
    models = {f: (np.maximum(n, 1e-12) / count, mean, covariances(f, n, s, ridge)) for f in families}
    size = k + k * d + k * d * d + 1
    last = {f: -np.inf for f in families}
    going, reached = list(families), {}
    for _ in range(max_iter + 1):

        def step(b: pa.RecordBatch, going=tuple(going), models=dict(models)) -> np.ndarray:
            x, out = rows_of(b, 1) - middle, []
            for f in going:
                r, total = responsibilities(x, models[f])
                out += [moments(x, r), [total.sum()]]
            return np.concatenate(out)

        sums = summed(own, step)
        for at, f in enumerate(list(going)):
            part = sums[at * size : (at + 1) * size]
            reached[f] = part[-1]
            if part[-1] - last[f] <= tolerance * abs(part[-1]):
                going.remove(f)
                continue
            last[f] = part[-1]
            n, mean, s = unpacked(part[:-1])
            held = n < 1
            cov = covariances(f, n, s, ridge)
            models[f] = (np.maximum(n, 1e-12) / n.sum(), np.where(held[:, None], models[f][1], mean), np.where(held[:, None, None], models[f][2], cov))
        if not going:
            break
    bic = {f: float(2 * reached[f] - parameters(f, k, d) * np.log(count)) for f in families}
    best = max(families, key=lambda f: (bic[f], -parameters(f, k, d)))
    model = models[best]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r, _ = responsibilities(rows_of(b, 1) - middle, model)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.argmax(axis=1).astype(np.int32)), pa.array(1 - r.max(axis=1))], names=["id", "cluster", "uncertainty"])

    out = kept(own.mapInArrow(label, "id long, cluster int, uncertainty double"))
    return canonical_labels(out.select("id", "cluster")).join(out.drop("cluster"), "id"), best, bic


def exchange(points: DataFrame, labels: DataFrame, max_iter: int = 30) -> DataFrame:
    """(id, cluster): ``labels(id, cluster)`` after moves of points that lower the total squared distance to cluster means.

    A point of a cluster with n points moves to one with m if m / (m + 1) times its squared
    distance there is less than n / (n - 1) times that to its own mean, which single moves of
    Lloyd's steps miss. Each round weighs all points against the same means and moves all that
    would gain; if that raises the cost, those with the larger gains only, at last the
    best alone, which always lowers it. It ends when no point gains or after ``max_iter`` rounds.
    A cluster's last point stays.
    """
    names = sorted(r.cluster for r in labels.select("cluster").distinct().collect())  # a row for each cluster
    at = {c: i for i, c in enumerate(names)}
    k = len(names)
    own = kept(points.join(labels, "id").select("id", F.col("v").cast("array<double>").alias("v"), F.element_at(F.create_map(*(F.lit(x) for c, i in at.items() for x in (c, i))), F.col("cluster")).alias("c")))
    if k < 2:
        return labels.select("id", "cluster")
    middle = summed(own, lambda b: np.append(rows_of(b, 1).sum(axis=0), b.num_rows))
    middle = middle[:-1] / middle[-1]

    def state(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        """Sizes, means and the cost."""

        def f(b: pa.RecordBatch) -> np.ndarray:
            x, r = rows_of(b, 1) - middle, np.eye(k)[b.column(2).to_numpy()]
            return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), [(x * x).sum()]])

        s = summed(df.select("id", "v", "c"), f)
        n, m = s[:k], s[k:-1].reshape(k, -1)
        return n, m / np.maximum(n, 1)[:, None], float(s[-1] - ((m * m).sum(axis=1) / np.maximum(n, 1)).sum())

    n, mean, cost = state(own)
    for _ in range(max_iter):

        def weigh(batches: Iterator[pa.RecordBatch], n=n, mean=mean) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, c = rows_of(b, 1) - middle, b.column(2).to_numpy()
                d = ((x[:, None, :] - mean[None]) ** 2).sum(axis=2)
                here = d[np.arange(len(c)), c] * np.where(n[c] > 1, n[c] / np.maximum(n[c] - 1, 1), 0)
                there = d * (n / (n + 1))
                there[np.arange(len(c)), c] = np.inf
                to = there.argmin(axis=1)
                gain = here - there[np.arange(len(c)), to]
                # Rounding is no gain.
                gain = np.where(gain > 1e-12 * (here + 1e-300), gain, 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(to.astype(np.int32)), pa.array(gain)], names=["id", "v", "c", "to", "gain"])

        weighed = kept(own.select("id", "v", "c").mapInArrow(weigh, "id long, v array<double>, c int, to int, gain double"))
        facts = weighed.where("gain > 0").agg(F.max("gain").alias("most"), F.max_by("id", F.struct("gain", -F.col("id"))).alias("best")).first()
        if facts.most is None:
            break
        for least in (0.0, facts.most / 8, facts.most / 2, None):
            moves = (F.col("gain") > least) if least is not None else (F.col("id") == facts.best)
            tried = weighed.select("id", "v", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c"))
            n_, mean_, cost_ = state(tried)
            if least is None or (cost_ < cost and (n_ > 0).all()):
                break
        own, n, mean, cost = kept(tried), n_, mean_, cost_
    back = F.element_at(F.create_map(*(F.lit(x) for c, i in at.items() for x in (i, c))), F.col("c"))
    return own.select("id", back.alias("cluster"))


def exchange_kmeans(points: DataFrame, k: int, starts: int = 10, max_iter: int = 30, seed: int = 0) -> DataFrame:
    """(id, cluster): ``kmeans`` improved by ``exchange``, canonical labels."""
    return canonical_labels(exchange(points, kmeans(points, k, starts, max_iter, seed), max_iter))
