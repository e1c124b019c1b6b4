"""Neighbour graphs as edge tables: symmetrisation, bandwidths, affinities, normalisation, products.

Directed neighbours are (src, dst, rank, dist); an undirected graph is (i, j, d) or
(i, j, w) with i < j, each edge once and no self-loops; a rectangular graph is (query, ref, w).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import gaussian


def select_knn(edges: DataFrame, n: int) -> DataFrame:
    """The first n of the stored neighbours."""
    return edges.where(F.col("rank") <= n)


def symmetric_graph(edges: DataFrame) -> DataFrame:
    """(i, j, d): union of the directed edges; the list of the larger end wins if both have the edge."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "src", "dist")
    return e.groupBy("i", "j").agg(F.max_by("dist", F.struct("src", "dist")).alias("d"))


def directed_graph(edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """(query, ref, w): the directed edges, self edges kept; with ``symmetric`` also reversed ones that are missing (A2)."""
    forward = edges.select(F.col("src").alias("query"), F.col("dst").alias("ref"), F.col("dist").alias("w"))
    if not symmetric:
        return forward
    back = edges.select(F.col("dst").alias("query"), F.col("src").alias("ref"), F.col("dist").alias("w"))
    return forward.unionByName(back.join(forward, ["query", "ref"], "left_anti"))


def mirrored(graph: DataFrame, value: str = "d") -> DataFrame:
    """(i, j, value) in both directions: every node's incident edges (A3)."""
    return graph.select("i", "j", value).unionByName(graph.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def subgraph(graph: DataFrame, nodes: DataFrame, value: str = "d") -> DataFrame:
    """Edges among ``nodes(old, new)``, renumbered (P7). ``new`` must rise with ``old``."""
    a = nodes.select(F.col("old").alias("i"), F.col("new").alias("a"))
    b = nodes.select(F.col("old").alias("j"), F.col("new").alias("b"))
    return graph.join(a, "i").join(b, "j").select(F.col("a").alias("i"), F.col("b").alias("j"), value)


def local_sigma(graph: DataFrame, k: int, order: str = "nearest") -> DataFrame:
    """(id, sigma): sum of k incident distances over k (A4).

    order "nearest" takes the k least, "index" the k neighbours with the least ids. A node
    with fewer has its sum divided by k all the same.
    """
    by = ["d", "j"] if order == "nearest" else ["j"]
    n = F.row_number().over(W.partitionBy("i").orderBy(*by))
    return mirrored(graph).withColumn("n", n).where(F.col("n") <= k).groupBy(F.col("i").alias("id")).agg((F.sum("d") / k).alias("sigma"))


def solve_bandwidth(d2: np.ndarray, perplexity: float) -> float:
    """sigma for which the entropy of exp(-d2 / 2 sigma^2) is log(perplexity); NaN if there is none."""
    target = np.log(perplexity)
    d2 = np.sort(d2) - d2.min()  # a shift leaves the distribution as it is
    if perplexity >= len(d2) or perplexity <= (d2 == 0).sum():
        return np.nan

    def entropy(b: float) -> float:
        beta = np.exp(b)
        w = np.exp(-beta * d2)
        return beta * (d2 * w).sum() / w.sum() + np.log(w.sum()) - target

    # The entropy falls as b grows.
    lo = hi = -np.log(d2.mean())
    while entropy(lo) < 0:
        lo -= 4
    while entropy(hi) > 0:
        hi += 4
    for _ in range(200):
        mid = (lo + hi) / 2
        if entropy(mid) > 0:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13:
            break
    return float(1 / np.sqrt(2 * np.exp((lo + hi) / 2)))


def entropic_sigma(graph: DataFrame, k: int, perplexity: float) -> DataFrame:
    """(id, sigma): bandwidth with the given perplexity over each node's k nearest incident edges (A5).

    The root is unique, so nodes are independent; null where no bandwidth has it.
    """
    n = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    near = mirrored(graph).withColumn("n", n).where(F.col("n") <= k)
    rows = near.groupBy(F.col("i").alias("id")).agg(F.collect_list("d").alias("ds"))

    @F.pandas_udf("double")
    def solve(ds: pd.Series) -> pd.Series:
        return ds.map(lambda x: solve_bandwidth(np.asarray(x, dtype=np.float64) ** 2, perplexity))

    return rows.select("id", F.nanvl(solve("ds"), F.lit(None).cast("double")).alias("sigma"))


def achieved_perplexity(graph: DataFrame, sigmas: DataFrame, k: int) -> DataFrame:
    """(id, perplexity) that a bandwidth gives over the k nearest incident edges."""
    n = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    near = mirrored(graph).withColumn("n", n).where(F.col("n") <= k).join(sigmas.withColumnRenamed("id", "i"), "i")
    near = near.withColumn("e", F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma")))
    near = near.withColumn("e", F.col("e") - F.min("e").over(W.partitionBy("i"))).withColumn("w", F.exp(-F.col("e")))
    g = near.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("e")).alias("s"))
    return g.select("id", F.exp(F.col("s") / F.col("z") + F.log("z")).alias("perplexity"))


def with_ends(graph: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Adds the value of both ends as value_i and value_j."""
    a = nodes.select(F.col("id").alias("i"), F.col(value).alias(f"{value}_i"))
    b = nodes.select(F.col("id").alias("j"), F.col(value).alias(f"{value}_j"))
    return graph.join(a, "i").join(b, "j")


def fixed_affinity(graph: DataFrame, sigma: float) -> DataFrame:
    """(i, j, w): Gaussian affinity with one bandwidth."""
    return graph.select("i", "j", gaussian(F.col("d"), F.lit(float(sigma) ** 2)).alias("w"))


def local_affinity(graph: DataFrame, sigmas: DataFrame) -> DataFrame:
    """(i, j, w): Gaussian affinity with the product of the ends' bandwidths."""
    return with_ends(graph, sigmas, "sigma").select("i", "j", gaussian(F.col("d"), F.col("sigma_i") * F.col("sigma_j")).alias("w"))


def outside_affinity(edges: DataFrame, sigmas: DataFrame | float) -> DataFrame:
    """(query, ref, w): Gaussian affinity with the bandwidth of the reference point, or a fixed one."""
    if not isinstance(sigmas, DataFrame):
        return edges.select("query", "ref", gaussian(F.col("w"), F.lit(float(sigmas) ** 2)).alias("w"))
    s = sigmas.select(F.col("id").alias("ref"), "sigma")
    return edges.join(s, "ref").select("query", "ref", gaussian(F.col("w"), F.col("sigma") * F.col("sigma")).alias("w"))


def degrees(affinity: DataFrame) -> DataFrame:
    """(id, degree): sum of a node's affinities."""
    return mirrored(affinity, "w").groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("degree"))


def normalised(affinity: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(i, j, w): affinity divided by the root of the ends' degrees (A10)."""
    degree = degrees(affinity) if degree is None else degree
    size = F.sqrt(F.col("degree_i") * F.col("degree_j"))
    return with_ends(affinity, degree, "degree").select("i", "j", F.when(size > 0, F.col("w") / size).alias("w"))


def normalised_outside(outside: DataFrame, degree: DataFrame) -> DataFrame:
    """(query, ref, w): out-of-sample affinity, divided by the roots of the reference degree and of its own row sum."""
    own = outside.groupBy("query").agg(F.sum("w").alias("own"))
    d = degree.select(F.col("id").alias("ref"), "degree")
    size = F.sqrt(F.col("degree") * F.col("own"))
    return outside.join(own, "query").join(d, "ref").select("query", "ref", F.when(size > 0, F.col("w") / size).alias("w"))


def mean_sigma(sigmas: DataFrame) -> DataFrame:
    """Average bandwidth."""
    return sigmas.agg(F.avg("sigma").alias("sigma"))


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, value): product of a symmetric (i, j, w), i <= j, with (id, value); a diagonal entry counts once."""
    off = matrix.where("i <> j")
    both = matrix.select("i", "j", "w").unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    v = vector.select(F.col("id").alias("j"), "value")
    return both.join(v, "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def multiply_outside(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, value): sum over the references of (query, ref, w) times their value."""
    v = vector.select(F.col("id").alias("ref"), "value")
    return matrix.join(v, "ref").groupBy(F.col("query").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
