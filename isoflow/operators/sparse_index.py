"""Exact k-nearest neighbours of sparse vectors by an inverted index with maximum-weight bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geometry import total
from .blocks import kept
from .knn import finite, knn_sparse
from .trajectory import rekey


def pair_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, r, dot) from rows (q, r, idx, val, other_idx, other_val) whose features are unique."""
    for b in batches:
        if not b.num_rows:
            continue
        keys, values = [], []
        for c in (2, 4):
            size = np.diff(b.column(c).offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            f = b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            o = np.lexsort((f, row))
            keys.append(np.stack([row[o], f[o]], axis=1))
            values.append(b.column(c + 1).flatten().to_numpy(zero_copy_only=False)[o])
        # The rows of both sides that meet are next to each other once sorted together.
        both = np.concatenate(keys)
        side = np.repeat([0, 1], [len(keys[0]), len(keys[1])])
        place = np.concatenate([np.arange(len(k)) for k in keys])
        o = np.lexsort((side, both[:, 1], both[:, 0]))
        meet = np.flatnonzero((both[o[1:]] == both[o[:-1]]).all(axis=1))
        x, y = place[o[meet]], place[o[meet + 1]]
        dot = np.bincount(keys[0][x, 0], values[0][x] * values[1][y], b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dot)], names=["q", "r", "dot"])


#: Postings that queries meet, as multiples of all pairs, beyond which blocks are compared instead; so many are met in any case.
MEETINGS, FEW_MEETINGS = 2, 20_000_000


def meetings(own: DataFrame, other: DataFrame) -> float:
    """Rows that a query's features meet in the postings, for all queries together: a sum over the features."""
    counts = [df.select(F.explode("idx").alias("f")).groupBy("f").agg(F.count("*").cast("double").alias(c)) for df, c in ((own, "a"), (other, "b"))]
    return counts[0].join(counts[1], "f").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0


def candidates(own: DataFrame, other: DataFrame, need: int, same_id: bool) -> DataFrame:
    """(q, r): the pairs of queries ``own`` and references ``other``, both (n, id, idx, val, norm), that can be near enough.

    References are numbered by their norm. With values that are not negative a query of norm a
    is no further than sqrt(a + m) from ``need`` references, m being the largest norm of so many of the least, so a
    reference of norm b must share a product of (b - m) / 2. A query goes through its features,
    those with short postings first; a reference whose first shared feature is the p-th shares
    no more than the products with the greatest weights from there on, which bounds the norms
    that its postings are read for. References without a shared feature only count
    among the least norms.
    """
    # Whatever id is left out, ``need`` rows of least norm remain among so many.
    least = other.withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy("n"))).where(F.col("turn") <= need)
    least = least.orderBy("n").limit(2 * need).select("n", "id", "norm")
    few = least.agg(F.array_sort(F.collect_list(F.struct("n", "id", "norm"))).alias("least"))
    at = own.crossJoin(F.broadcast(few))
    rest = F.filter("least", lambda t: t["id"] != F.col("id")) if same_id else F.col("least")
    at = at.withColumn("m", F.get(rest, F.lit(need - 1))["norm"])
    postings = other.select(F.col("n").alias("r"), "norm", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("r", F.col("norm").alias("b"), F.col("e.idx").alias("f"), F.col("e.val").alias("w"))
    features = postings.groupBy("f").agg(F.max("w").alias("most"), F.count("*").alias("df"))
    terms = at.select(F.col("n").alias("q"), "m", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("q", "m", F.col("e.idx").alias("f"), (F.col("e.val")).alias("v"))
    terms = terms.join(features, "f")
    after = W.partitionBy("q").orderBy("df", "f").rowsBetween(0, W.unboundedFollowing)
    # Without so many references there is no bound.
    limit = F.coalesce(F.col("m") + 2 * F.sum(F.col("v") * F.col("most")).over(after), F.lit(float("inf")))
    terms = terms.select("q", "f", (limit * (1 + 1e-9) + 1e-9).alias("limit"))
    shared = terms.join(postings.select("f", "r", "b"), "f").where(F.col("b") <= F.col("limit")).select("q", "r")
    by_norm = at.select(F.col("n").alias("q"), F.explode("least").alias("t")).select("q", F.col("t.n").alias("r"))
    return shared.unionByName(by_norm).distinct()


def knn_sparse_indexed(ref: DataFrame, k: int, query: DataFrame | None = None, exclude: str = "self") -> DataFrame:
    """(src, dst, rank, dist) as ``knn_sparse`` gives them, by an inverted index.

    For vectors of many features of which few are shared. Values must not be negative, and the
    features of a query meet no more postings than MEETINGS times the references on average or FEW_MEETINGS in all, counted first, else
    ``knn_sparse`` is taken, whatever their number, which gives the same rows; features must be unique within a row. Rows whose two arrays
    differ in length or hold nulls or non-finite values are left out, as are null ids.
    """
    if exclude not in ("self", "rank0", "none"):
        raise ValueError(f"exclude: {exclude}")
    if k < 1:
        raise ValueError("k must be 1 or more")
    sound = F.col("id").isNotNull() & (F.size("idx") == F.size("val")) & F.forall("idx", lambda x: x.isNotNull()) & F.forall("val", finite)
    own = ref if query is None else query
    if not ref.unionByName(own).where(sound & F.exists("val", lambda x: x < 0)).isEmpty():
        return knn_sparse(ref, k, query, exclude)

    def placed(df: DataFrame) -> DataFrame:
        rows = df.where(sound).select("id", "idx", F.col("val").cast("array<double>").alias("val"))
        rows = rows.withColumn("norm", total(F.transform("val", lambda x: x * x))).withColumn("order", F.struct("norm", "id"))
        return kept(rekey(rows, "order", "n").select("n", "id", "idx", "val", "norm"))

    refs, queries = placed(ref), placed(own)
    if meetings(queries, refs) > max(FEW_MEETINGS, MEETINGS * refs.count() * queries.count()):
        # Postings would name each pair again and again.
        return knn_sparse(ref, k, query, exclude)
    drop = 1 if exclude == "rank0" else 0
    need = k + drop
    pairs = candidates(queries, refs, need, exclude == "self")
    pairs = pairs.join(queries.select(F.col("n").alias("q"), F.col("id").alias("src"), "idx", "val", F.col("norm").alias("a")), "q")
    pairs = pairs.join(refs.select(F.col("n").alias("r"), F.col("id").alias("dst"), F.col("idx").alias("other_idx"), F.col("val").alias("other_val"), F.col("norm").alias("b")), "r")
    if exclude == "self":
        pairs = pairs.where("src <> dst")
    dots = pairs.select("q", "r", "idx", "val", "other_idx", "other_val").mapInArrow(pair_products, "q long, r long, dot double")
    ends = dots.join(queries.select(F.col("n").alias("q"), F.col("id").alias("src"), F.col("norm").alias("a")), "q").join(refs.select(F.col("n").alias("r"), F.col("id").alias("dst"), F.col("norm").alias("b")), "r")
    square = F.col("a") + F.col("b") - 2 * F.col("dot")
    ends = ends.withColumn("dist", F.sqrt(F.when(square > 1e-12, square).otherwise(0.0)))
    rank = F.row_number().over(W.partitionBy("q").orderBy("dist", "dst", "r")) - drop
    return ends.withColumn("rank", rank.cast("long")).where((F.col("rank") >= 1) & (F.col("rank") <= k)).select("src", "dst", "rank", "dist")
