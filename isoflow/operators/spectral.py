"""Eigenpairs of symmetric graphs, extension to further points, scaling, bisection.

Graphs of up to DRIVER_NODES nodes and DRIVER_EDGES edges, which are counted first, are solved
by LAPACK, those of up to SPARSE_NODES nodes and as many edges by Krylov spans on the driver, all
others by the block method of ``blocks``, whose only collected values are small matrices. All end
within the same residual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.geometry import ROOT_EPS
from . import blocks, graph as g, krylov, paths
from .cluster import lloyd, lloyd_by_set

#: Nodes and edges of a graph that LAPACK solves at once on the driver; landmarks that are scaled there.
DRIVER_NODES, DRIVER_EDGES, LANDMARKS = 4096, 2_000_000, 2048
#: Nodes of a graph whose edges fit the driver, for a span of some tens of vectors.
SPARSE_NODES = 131_072
#: Nodes and edges of a set that one task bisects with LAPACK; larger ones go by blocks.
SET_NODES, SET_EDGES = 2048, 1_000_000


def collect_matrix(edges: DataFrame, ids: list[int]) -> np.ndarray:
    a = np.zeros((len(ids), len(ids)))
    rows = edges.select("i", "j", "w").toArrow()
    i, j = (np.searchsorted(ids, rows.column(c).to_numpy()) for c in ("i", "j"))
    a[i, j] = a[j, i] = rows.column("w").to_numpy()
    return a


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Columns with a positive sum, or failing that a positive largest entry."""
    if not v.size:
        return v
    s = v.sum(axis=0)
    big = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(np.where(np.abs(s) > 1e-9, s, big) < 0, -1.0, 1.0)


def top_eigs(edges: DataFrame, n: int, iterations: int = 300, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(k, eigenvalue, residual, converged) and (id, k, value) of the n largest eigenvalues.

    ``edges(i, j, w)`` has each edge once; edges without a weight, as those of nodes whose
    bandwidth is 0, are left out, and so are nodes without any other edge. k goes from 1 by
    falling eigenvalue. The residual is |Av - lv| / |l|; converged tells whether it is within
    the root of the machine epsilon.
    """
    spark = edges.sparkSession
    edges = blocks.kept(edges.where("w IS NOT NULL AND NOT isnan(w)").select("i", "j", "w"))
    few = edges.count() <= DRIVER_EDGES
    nodes = edges.select(F.col("i").alias("id")).union(edges.select("j")).distinct().limit(SPARSE_NODES + 1).count() if few else 0
    if few and nodes <= SPARSE_NODES:
        rows = edges.toArrow()
        i, j, w = (rows.column(c).to_numpy() for c in ("i", "j", "w"))
        ids = np.unique(np.concatenate([i, j]))
        i, j = np.searchsorted(ids, i), np.searchsorted(ids, j)
        n = min(n, len(ids))
        if len(ids) <= DRIVER_NODES:
            a = np.zeros((len(ids), len(ids)))
            a[i, j] = a[j, i] = w
            val, vec = np.linalg.eigh(a)
            val, vec = val[::-1][:n], vec[:, ::-1][:, :n]
            res = np.linalg.norm(a @ vec - vec * val, axis=0) / np.abs(val)
        else:
            val, vec, res = krylov.largest(krylov.sparse_times(len(ids), i, j, w), len(ids), n, ROOT_EPS, restarts=iterations, seed=seed)
        values = [(k + 1, float(val[k]), float(res[k]), bool(res[k] <= ROOT_EPS)) for k in range(n)]
        return spark.createDataFrame(values, VALUES), by_place(spark, ids, fix_signs(vec))
    return block_eigs(edges, n, iterations, seed)


VALUES = "k int, eigenvalue double, residual double, converged boolean"


def by_place(spark: SparkSession, ids: np.ndarray, x: np.ndarray) -> DataFrame:
    """(id, k, value) of a matrix with a row for each id, k from 1."""
    n, m = x.shape
    columns = [pa.array(np.repeat(ids.astype(np.int64), m)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), pa.array(np.ascontiguousarray(x).ravel())]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=["id", "k", "value"]), "id long, k int, value double")


def block_eigs(edges: DataFrame, n: int, iterations: int = 300, seed: int = 42, tolerance: float = ROOT_EPS, rows: int | None = None, aim: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``top_eigs`` by products of packed blocks, for graphs of any size; ``aim`` as in ``blocks.largest_eigs``."""
    pairs, vectors = blocks.largest_eigs(edges.select(F.lit(0).alias("set"), "i", "j", "w"), n, iterations, seed, tolerance=tolerance, rows=rows, aim=aim)
    values = [(k, value, residual, residual <= ROOT_EPS) for _, k, value, residual in pairs]
    return edges.sparkSession.createDataFrame(values, VALUES), vectors.select("id", "k", "value")


def subspace_eigs(edges: DataFrame, nodes: DataFrame, n: int, iterations: int, seed: int, tolerance: float = ROOT_EPS) -> tuple[DataFrame, DataFrame]:
    """``block_eigs``; the nodes are those of the edges."""
    return block_eigs(edges, n, iterations, seed, tolerance)


def decompose(graph: DataFrame, n: int, sigma: float | None = None, k_sigma: int | None = None, perplexity: float | None = None, order: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Top eigenpairs of the normalised affinity of (i, j, d): fixed, local or entropic bandwidth."""
    if sigma is not None:
        a = g.fixed_affinity(graph, sigma)
    else:
        s = g.entropic_sigma(graph, k_sigma, perplexity) if perplexity else g.local_sigma(graph, k_sigma, order)
        a = g.local_affinity(graph, s)
    return top_eigs(g.normalised(a), n)


def extend(vectors: DataFrame, values: DataFrame, outside: DataFrame) -> DataFrame:
    """(id, k, value) of further points: sum over references of the normalised affinity times vector / eigenvalue."""
    scaled = vectors.join(F.broadcast(values.select("k", "eigenvalue")), "k").select(F.col("id").alias("ref"), "k", F.expr("try_divide(value, eigenvalue)").alias("v"))
    return outside.join(scaled, "ref").groupBy(F.col("query").alias("id"), "k").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def decompose_outside(graph: DataFrame, edges: DataFrame, n: int, sigma: float | None = None, k_sigma: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eigenpairs of the landmarks' (i, j, d) and their extension to the queries of (query, ref, w) distances."""
    s = sigma if sigma is not None else g.local_sigma(graph, k_sigma)
    a = g.fixed_affinity(graph, sigma) if sigma is not None else g.local_affinity(graph, s)
    d = g.degrees(a)
    values, vectors = top_eigs(g.normalised(a, d), n)
    return values, vectors, extend(vectors, values, g.normalised_outside(g.outside_affinity(edges, s), d))


def double_centred(d: DataFrame) -> DataFrame:
    """(i, j, b) from all pairs (i, j, d), i <= j: -1/2 (d^2 - row mean - column mean + grand mean)."""
    sq = d.withColumn("q", F.col("d") * F.col("d"))
    both = sq.select("i", "j", "q").unionByName(sq.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "q"))
    # A row for each point, of which the pairs are the square; pairs stay where they are.
    means = F.broadcast(both.groupBy(F.col("i").alias("id")).agg(F.avg("q").alias("mean")))
    grand = both.agg(F.avg("q").alias("grand"))
    return g.with_ends(sq, means, "mean").crossJoin(F.broadcast(grand)).select("i", "j", (-0.5 * (F.col("q") - F.col("mean_i") - F.col("mean_j") + F.col("grand"))).alias("b"))


def classical_scaling(d: DataFrame, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(k, eigenvalue) and (id, k, value): coordinates vector * sqrt|eigenvalue| of the centred matrix.

    Needs all pairs; those without a distance raise an error. Up to LANDMARKS points go to
    LAPACK on the driver. More are scaled by ``scaled_rows`` for some ``dims``, where the matrix stays in a table; all
    dimensions of more raise an error.
    """
    spark = d.sparkSession
    nodes = blocks.kept(d.select(F.col("i").alias("id")).union(d.select("j")).distinct())
    size = nodes.count()
    if size > LANDMARKS and dims is None:
        raise ValueError(f"all dimensions are for {LANDMARKS} points at most; take some")
    pairs = d.where("d IS NOT NULL AND NOT isnan(d)").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    missing = ValueError("scaling needs a distance of every pair; take the parts of the graph one by one")
    if size > LANDMARKS:
        ids = np.sort(nodes.toArrow().column("id").to_numpy())
        return scaled_rows(blocks.kept(rows_of_pairs(pairs, ids)), ids, dims, missing)
    if pairs.select("i", "j").distinct().count() < size * (size + 1) // 2:
        raise missing
    ids = sorted(r.id for r in nodes.collect())
    b = collect_matrix(double_centred(d).withColumnRenamed("b", "w"), ids)
    val, vec = np.linalg.eigh(b)
    n = len(ids) if dims is None else min(dims, len(ids))
    return axes(spark, np.array(ids, dtype=np.int64), val[::-1][:n], vec[:, ::-1][:, :n])


def axes(spark: SparkSession, ids: np.ndarray, val: np.ndarray, vec: np.ndarray) -> tuple[DataFrame, DataFrame]:
    values = spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(val)], "k int, eigenvalue double")
    return values, by_place(spark, ids, fix_signs(vec) * np.sqrt(np.abs(val)))


def rows_of_pairs(pairs: DataFrame, ids: np.ndarray) -> DataFrame:
    """(at, first, x) of (i, j, d), i <= j, as ``paths.in_tasks`` has them, from the diagonal on; NaN where there is no distance."""
    sent = pairs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for b in batches:
            at = np.searchsorted(names, b.column(0).to_numpy())
            for n, row in zip(at, b.column(1)):
                y = np.full(len(names) - n, np.nan)
                y[np.searchsorted(names, row.values.field(0).to_numpy(zero_copy_only=False)) - n] = row.values.field(1).to_numpy(zero_copy_only=False)
                yield paths.packed_rows([n], [n], [y])

    own = pairs.groupBy("i").agg(F.collect_list(F.struct("j", "d")).alias("row"))
    return own.mapInArrow(run, paths.ROWS)


def scaled_rows(rows: DataFrame, ids: np.ndarray, dims: int, missing: ValueError) -> tuple[DataFrame, DataFrame]:
    """``classical_scaling`` of rows (at, first, x): for each id its distances to all ids, or to those from its own place on.

    The table is read once for each product with some columns, which the driver centres; it
    holds a few columns as long as there are points, and a task holds them and some rows.
    """
    spark, size = rows.sparkSession, len(ids)
    if rows.select("at").distinct().count() < size:
        raise missing
    parts = max(1, min(spark.sparkContext.defaultParallelism, size // 1024))

    def times(v: np.ndarray) -> np.ndarray:
        v = v - v.mean(axis=0)
        sent = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = sent.value
            y = np.zeros_like(v)
            for b in batches:
                for at, first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    q = np.frombuffer(data.as_buffer(), dtype=np.float64)
                    low, high = max(at, first), first + len(q)
                    if low >= high:
                        continue  # the other triangle
                    q = q[low - first :] ** 2
                    y[at] += q @ v[low:high]
                    if low == at:
                        low, q = low + 1, q[1:]
                    y[low:high] += q[:, None] * v[at]
            for k in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(y[k::parts]).tobytes()], pa.binary())], names=["part", "y"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, y in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(y.as_buffer(), dtype=np.float64)
                    sums[k] = sums[k] + x if k in sums else x
            for k, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "y"])

        y = np.empty_like(v)
        partial = rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "part int, y binary")
        for r in partial.repartitionById(parts, "part").mapInArrow(add, "part int, y binary").collect():  # as much as v
            y[r.part :: parts] = np.frombuffer(r.y).reshape(-1, v.shape[1])
        sent.destroy()
        if not np.isfinite(y).all():
            raise missing
        return -0.5 * (y - y.mean(axis=0))

    val, vec, _ = krylov.largest(times, size, min(dims, size), ROOT_EPS, aim=1e-11, relative=False, dear=True)
    return axes(spark, ids, val, vec)


def geodesic_scaling(graph: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """``classical_scaling`` of the shortest paths of (i, j, d), without their pairs as rows where tasks can hold the graph."""
    edges, nodes = paths.ways(graph)
    if not paths.fits_tasks(edges, nodes) or nodes.count() <= LANDMARKS:
        return classical_scaling(paths.all_pairs(graph), dims)
    rows, ids = paths.in_tasks(edges, nodes, nodes, True)
    return scaled_rows(blocks.kept(rows), ids, dims, ValueError("scaling needs a connected graph; take its parts one by one"))


def landmark_scaling(d: DataFrame, outside: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(k, eigenvalue) and (id, k, value) of landmarks and any number of further points.

    ``d(i, j, d)``, i <= j, has all pairs of landmarks, LANDMARKS at most; ``outside(query, ref, w)``
    the distances of each further point to every landmark. Landmarks are scaled as a whole;
    a further point is placed where its squared distances say, by one join with the
    landmarks' table and a sum. Eigenvalues that are not positive span no axis, so there may be fewer
    than ``dims``. Points that lack the distance to a landmark are left out. Distances between
    points in a space of no more than ``dims`` dimensions, which the landmarks span, come out exact.
    """
    values, own = classical_scaling(d, dims)
    top = values.agg(F.max("eigenvalue")).first()[0]  # a row for each dimension
    values = values.where(F.col("eigenvalue") > 1e-9 * (top or 0.0))
    own = own.join(F.broadcast(values), "k")
    n = values.count()
    sq = g.mirrored(d.where("i <> j")).groupBy(F.col("i").alias("ref")).agg(F.sum(F.col("d") * F.col("d")).alias("t"), (F.count("*") + 1).alias("m"))
    # The inverse of the landmarks' coordinates: vector / sqrt(eigenvalue).
    axis = own.groupBy(F.col("id").alias("ref")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("value") / F.col("eigenvalue")).alias("x")))), lambda s: s["x"]).alias("axis"))
    table = axis.join(sq, "ref").select("ref", "axis", (F.col("t") / F.col("m")).alias("mean"), "m")
    # LANDMARKS rows at most.
    far = outside.join(F.broadcast(table), "ref").withColumn("q", (F.col("mean") - F.col("w") * F.col("w")) / 2)
    placed = far.groupBy(F.col("query").alias("id")).agg(F.array(*(F.sum(F.col("q") * F.col("axis")[k]) for k in range(n))).alias("v"), F.count("q").alias("there"), F.max("m").alias("m"))
    placed = placed.where("there = m").select("id", F.posexplode("v").alias("k", "value")).select("id", (F.col("k") + 1).alias("k"), "value")
    return values, own.select("id", "k", "value").unionByName(placed)


def solve_sets(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, id, half, t) of ``members(path, id)``: the halves of each set by 2-means on its two leading vectors, and its relaxation time.

    ``edges(path, i, j, w)`` are those within a set. t is null, and so is half, where a set has
    fewer than three nodes or one without an edge.
    """
    spark = members.sparkSession
    linked = edges.select("path", F.col("i").alias("id"), "w").union(edges.select("path", "j", "w")).groupBy("path", "id").agg(F.sum("w").alias("degree"), F.count("*").alias("links"))
    members = blocks.kept(members.join(linked, ["path", "id"], "left"))
    sizes = members.groupBy("path").agg(F.count("*").alias("n"), (F.sum(F.coalesce("links", F.lit(0))) / 2).alias("edges"), F.min(F.coalesce("degree", F.lit(0.0))).alias("least"))
    sizes = blocks.kept(sizes)
    sound = sizes.where("n >= 3 AND least > 0")
    small = sound.where((F.col("n") <= SET_NODES) & (F.col("edges") <= SET_EDGES)).select("path")
    large = sound.select("path").join(small, "path", "left_anti")

    def solve(key, own: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(own.id.to_numpy())
        i, j = np.searchsorted(ids, e.i), np.searchsorted(ids, e.j)
        a = np.zeros((len(ids), len(ids)))
        a[i, j] = a[j, i] = e.w
        degree = a.sum(axis=1)
        val, vec = np.linalg.eigh(a / np.sqrt(np.outer(degree, degree)))
        t = np.inf if 1 - val[-2] <= 1e-12 else 1 / (1 - val[-2])
        return pd.DataFrame({"path": key[0], "id": ids, "half": lloyd(vec[:, [-1, -2]], 2, seed=42).astype(np.int32), "t": t})

    out = "path string, id long, half int, t double"
    inside = edges.join(small, "path").select(F.col("path").alias("of"), "i", "j", "w")
    done = members.join(small, "path").groupBy("path").cogroup(inside.groupBy("of")).applyInPandas(solve, out)
    rest = members.join(sound, "path", "left_anti").select("path", "id", F.lit(None).cast("int").alias("half"), F.lit(None).cast("double").alias("t"))
    paths = sorted(r.path for r in large.collect())  # one for each SET_NODES nodes at most
    if not paths:
        return done.unionByName(rest)
    number = spark.createDataFrame([(p, n) for n, p in enumerate(paths)], "path string, set long")
    d = members.join(number, "path").select("set", "id", "degree")
    e = edges.join(number, "path").join(d.select("set", F.col("id").alias("i"), F.col("degree").alias("a")), ["set", "i"]).join(d.select("set", F.col("id").alias("j"), F.col("degree").alias("b")), ["set", "j"])
    pairs, vectors = blocks.largest_eigs(e.select("set", "i", "j", (F.col("w") / F.sqrt(F.col("a") * F.col("b"))).alias("w")), 2)
    times = [(paths[s], float("inf") if 1 - value <= 1e-12 else 1 / (1 - value)) for s, k, value, _ in pairs if k == 2]
    points = vectors.groupBy("set", "id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v")).select("set", "id", F.transform("v", lambda x: x["value"]).alias("v"))
    halves = lloyd_by_set(blocks.kept(points), 2, seed=42).join(number, "set").join(spark.createDataFrame(times, "path string, t double"), "path")
    return done.unionByName(rest).unionByName(halves.select("path", "id", F.col("cluster").alias("half"), "t"))


def bisect(spark: SparkSession, graph: DataFrame, sigma: float = 1.0, relaxation: float = 1.2, partition: float = 2.0) -> DataFrame:
    """(id, cluster): recursive bisection by relaxation times; clusters are numbered from 1 as they are settled.

    A set is split by 2-means on its two leading vectors. It is settled if it or a half
    cannot be solved or a half is empty, or if its time 1 / (1 - l2) is below ``relaxation``
    times the sum of its halves'. If one half is slower than the other by more than
    ``partition``, the faster is settled and the slower goes on, else both go on, the second
    first. All sets of a level are solved together: small ones each in a task, larger ones
    side by side in blocks, so there is no bound. Edges without a distance are left out.
    """
    edges = blocks.kept(g.fixed_affinity(graph, sigma).where("w IS NOT NULL").select(F.lit("").alias("path"), "i", "j", "w"))
    # The path orders sets as they are settled.
    members = edges.select("path", F.col("i").alias("id")).union(edges.select("path", "j")).distinct()
    now = blocks.kept(solve_sets(members, edges))
    settled = now.where("half IS NULL").select("path", "id")
    active = now.where("half IS NOT NULL")
    while not active.isEmpty():
        half = active.select("path", "id", "half", "t")
        ends = half.select("path", "id", "half")
        inside = edges.join(ends.select("path", F.col("id").alias("i"), F.col("half").alias("a")), ["path", "i"]).join(ends.select("path", F.col("id").alias("j"), F.col("half").alias("b")), ["path", "j"])
        child = F.concat("path", F.lit("/"), "half")
        # A half's place is put in once it is known which goes on.
        edges = blocks.kept(inside.where("a = b").select(F.concat("path", F.lit("/"), "a").alias("path"), "i", "j", "w"))
        solved = blocks.kept(solve_sets(half.select(child.alias("path"), "id"), edges))
        times = solved.groupBy("path").agg(F.max("t").alias("t"))
        up, which = F.expr("substring(path, 1, length(path) - 2)"), F.expr("right(path, 1)")
        both = times.groupBy(up.alias("path")).agg(F.max(F.when(which == "0", F.col("t"))).alias("t0"), F.max(F.when(which == "1", F.col("t"))).alias("t1"))
        known = both.join(half.groupBy("path").agg(F.max("t").alias("t")), "path")
        split = F.col("t0").isNotNull() & F.col("t1").isNotNull() & ~(F.col("t") < relaxation * (F.col("t0") + F.col("t1")))
        one = F.greatest("t0", "t1") > partition * F.least("t0", "t1")
        slow = F.when(F.col("t0") >= F.col("t1"), 0).otherwise(1)
        # The half whose turn is first: the settled one, or the second of two that go on.
        first = F.when(one, 1 - slow).otherwise(1)
        verdict = blocks.kept(known.select("path", split.alias("split"), one.alias("one"), first.alias("first")))
        stays = half.join(verdict.where("NOT split"), "path").select("path", "id")
        goes = solved.withColumn("up", up).withColumn("which", which.cast("int")).join(verdict.where("split").withColumnRenamed("path", "up"), "up")
        new = F.concat("up", F.when(F.col("which") == F.col("first"), "a").otherwise("b"))
        goes = blocks.kept(goes.select("path", new.alias("new"), "id", "half", "t", (F.col("one") & (F.col("which") == F.col("first"))).alias("done")))
        settled = blocks.kept(settled.unionByName(stays).unionByName(goes.where("done").select(F.col("new").alias("path"), "id")))
        renamed = goes.where("NOT done").select("path", "new").distinct()
        edges = blocks.kept(edges.join(renamed, "path").select(F.col("new").alias("path"), "i", "j", "w"))
        active = goes.where("NOT done").select(F.col("new").alias("path"), "id", "half", "t")
    number = settled.select("path").distinct().select("path", F.row_number().over(W.orderBy("path")).cast("int").alias("cluster"))  # one row for each cluster
    return settled.join(number, "path").select("id", "cluster")
