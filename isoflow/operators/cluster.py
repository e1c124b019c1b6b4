"""Clusterings of embedded points and what is derived from labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from .blocks import kept
from .trajectory import rekey


def coordinates(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, v) from (id, k, value): the first ``dims`` values as an array."""
    d = vectors.where(F.col("k") <= dims).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    return d.select("id", F.transform("s", lambda x: x["value"]).alias("v"))


def canonical_labels(labels: DataFrame) -> DataFrame:
    """(id, cluster): clusters renumbered from 1 by their median id.

    Rows are numbered by cluster and id range by range, and the middle ones looked up, so no
    task holds a cluster. Points without an id or a cluster are left out.
    """
    own = kept(labels.where("id IS NOT NULL AND cluster IS NOT NULL").select("id", "cluster"))
    at = kept(rekey(own.select("id", "cluster", F.struct("cluster", "id").alias("order")), "order", "at").select("id", "cluster", "at"))
    sizes = at.groupBy("cluster").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min("id").alias("low"))
    middle = sizes.select("cluster", "low", F.explode(F.array(F.col("first") + F.floor((F.col("n") - 1) / 2), F.col("first") + F.ceil((F.col("n") - 1) / 2))).alias("at"))
    med = middle.join(at.select("at", "id"), "at").groupBy("cluster", "low").agg(F.avg("id").alias("m"))
    new = med.select("cluster", F.row_number().over(W.orderBy("m", "low")).cast("int").alias("new"))  # one row for each cluster
    return own.join(new, "cluster").select("id", F.col("new").alias("cluster"))


def kmeans(points: DataFrame, k: int, starts: int = 10, max_iter: int = 30, seed: int = 0) -> DataFrame:
    """(id, cluster) of (id, v): the best of several seeded runs by total distance, canonical labels."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    if points.isEmpty():
        return points.select("id", F.lit(None).cast("int").alias("cluster"))
    p = kept(points.select("id", "v")).select("id", array_to_vector("v").alias("features"))
    runs = [KMeans(k=k, seed=seed + s, maxIter=max_iter).fit(p) for s in range(starts)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    return canonical_labels(best.transform(p).select("id", F.col("prediction").alias("cluster")))


def gaussian_mixture(points: DataFrame, k: int, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """(id, cluster, uncertainty): full-covariance mixture; uncertainty is 1 minus the largest posterior."""
    if points.isEmpty():
        return points.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("uncertainty"))
    p = kept(points.select("id", "v")).select("id", array_to_vector("v").alias("features"))
    out = GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(p).transform(p)
    out = out.select("id", F.col("prediction").alias("cluster"), (1 - F.array_max(vector_to_array("probability"))).alias("uncertainty"))
    return canonical_labels(out.select("id", "cluster")).join(out.drop("cluster"), "id")


def lloyd(x: np.ndarray, k: int, starts: int = 25, max_iter: int = 30, seed: int = 42) -> np.ndarray:
    """Labels of the best of several runs from distinct random points; ties go to the lower centre."""
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), dtype=np.int64)
    for _ in range(starts):
        centres = x[rng.choice(len(x), k, replace=False)]
        own = None
        for _ in range(max_iter):
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if own is not None and (new == own).all():
                break
            own = new
            centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        cost = d.min(axis=1).sum()
        if cost < best:
            best, labels = cost, own
    return labels


def lloyd_by_set(points: DataFrame, k: int, starts: int = 25, max_iter: int = 30, seed: int = 42) -> DataFrame:
    """(set, id, cluster from 0) of ``points(set, id, v)``: ``lloyd`` of every set in the same passes.

    Each pass assigns all points for all starts and adds up in the tasks; centres, a few
    numbers for each set and start, come to the driver. Starting centres are points with the
    least hashes, so runs agree.
    """
    spot = F.row_number().over(W.partitionBy("set").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    first: dict[int, list] = {}
    for r in points.withColumn("spot", spot).where(F.col("spot") <= k * starts).orderBy("set", "spot").collect():
        first.setdefault(r["set"], []).append(r.v)
    # In a small set some points start twice.
    centres = {s: np.array([v[(a * k + c) % len(v)] for a in range(starts) for c in range(k)]).reshape(starts, k, -1) for s, v in first.items()}

    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x[:, None, None, :] - c[None]) ** 2).sum(axis=3)

    def groups(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        sets = b.column(0).to_numpy()
        x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
        for s in np.unique(sets):
            at = np.flatnonzero(sets == s)
            yield int(s), at, x[at]

    def sums(centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of each set, for each start: how many points each centre has, their sum, and the cost."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for s, _, x in groups(b) if b.num_rows else ():
                    d = near(x, centres[s])
                    own = d.argmin(axis=2)
                    add = np.zeros((starts, k, x.shape[1] + 2))
                    for c in range(k):
                        m = (own == c).astype(float)
                        add[:, c, 0], add[:, c, 1:-1], add[:, c, -1] = m.sum(axis=0), m.T @ x, (m * d[:, :, c]).sum(axis=0)
                    held[s] = held[s] + add if s in held else add
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["set", "x"])

        total: dict[int, np.ndarray] = {}
        for r in points.select("set", "id", "v").mapInArrow(run, "set long, x binary").collect():
            x = np.frombuffer(r.x).reshape(starts, k, -1)
            total[r["set"]] = total[r["set"]] + x if r["set"] in total else x
        return total

    for _ in range(max_iter):
        new = {s: np.where(x[:, :, :1] > 0, x[:, :, 1:-1] / np.maximum(x[:, :, :1], 1), centres[s]) for s, x in sums(centres).items()}
        still = all(np.array_equal(new[s], centres[s]) for s in new)
        centres = new
        if still:
            break
    best = {s: centres[s][[x[:, :, -1].sum(axis=1).argmin()]] for s, x in sums(centres).items()}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, dtype=np.int32)
            for s, at, x in groups(b) if b.num_rows else ():
                out[at] = near(x, best[s]).argmin(axis=2)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["set", "id", "cluster"])

    return points.select("set", "id", "v").mapInArrow(label, "set long, id long, cluster int")


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster): the nearest of (cluster, v), the lower cluster on ties: one assignment step.

    There are k centres, which a model holds whole; they are broadcast.
    """
    sq = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    cs = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster"), F.col("v").alias("c")))).alias("cs"))
    near = F.transform("cs", lambda c: F.struct(F.aggregate(F.zip_with("v", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["cluster"].alias("cluster")))
    return points.crossJoin(F.broadcast(cs)).select("id", F.array_min(near)["cluster"].alias("cluster"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, v): mean of each cluster's points: one update step."""
    long = points.join(labels, "id").select("cluster", F.posexplode("v").alias("n", "x")).groupBy("cluster", "n").agg(F.avg("x").alias("x"))
    return long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("v"))


def shares(labels: DataFrame) -> DataFrame:
    """(cluster, n, percent), and the mean ``uncertainty`` of each cluster if the labels have one."""
    more = [F.avg("uncertainty").alias("uncertainty")] if "uncertainty" in labels.columns else []
    c = labels.groupBy("cluster").agg(F.count("*").alias("n"), *more)
    share = (100.0 * F.col("n") / F.sum("n").over(W.partitionBy())).alias("percent")  # one row for each cluster
    return c.select("cluster", "n", share, *(["uncertainty"] if more else []))


def representatives(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, id): the point nearest to its cluster's mean, the first on ties."""
    sq = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    means = centroids(points, labels).withColumnRenamed("v", "c")
    d = points.join(labels, "id").join(means, "cluster").select("cluster", "id", sq.alias("d"))
    return d.groupBy("cluster").agg(F.min_by("id", F.struct("d", "id")).alias("id"))
