"""Statistics of neighbour tables and of clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import gaussian
from .trajectory import rekey

#: Neighbour counts taken by default (fixed values); those above the stored neighbours are left out.
NEIGHBOUR_SET = (2, 3, 4, 6, 8, 16, 32, 64, 128, 256, 512, 1024)
#: Points of a windowed estimate that one task puts in order.
WINDOW_ROWS = 100_000


def kernel_sums(edges: DataFrame, sigma: float | None) -> DataFrame:
    """(id, s, n): sum of Gaussian kernels of a point's neighbour distances; sigma defaults to the sample deviation of all."""
    if sigma is None:
        e = edges.crossJoin(F.broadcast(edges.agg(F.stddev_samp("dist").alias("sigma"))))  # one row
    else:
        e = edges.withColumn("sigma", F.lit(float(sigma)))
    return e.groupBy(F.col("src").alias("id")).agg(F.sum(gaussian(F.col("dist"), F.col("sigma") * F.col("sigma"))).alias("s"))


def density(edges: DataFrame, k: int, sigma: float | None = None) -> DataFrame:
    """(id, value): mean kernel over k neighbours."""
    return kernel_sums(edges, sigma).select("id", (F.col("s") / k).alias("value"))


def probability(edges: DataFrame, sigma: float | None = None) -> DataFrame:
    """(id, value): kernel sums that add up to 1."""
    s = kernel_sums(edges, sigma)
    return s.crossJoin(F.broadcast(s.agg(F.sum("s").alias("t")))).select("id", (F.col("s") / F.col("t")).alias("value"))


def entropy(edges: DataFrame, densities: DataFrame, k: int) -> DataFrame:
    """(id, value): minus the mean log2 density of the k neighbours."""
    d = densities.select(F.col("id").alias("dst"), F.log2("value").alias("l"))
    return edges.join(d, "dst").groupBy(F.col("src").alias("id")).agg((-F.sum("l") / k).alias("value"))


def _terms(edges: DataFrame, ks: list[int]) -> DataFrame:
    """(id, k, num, den) of the likelihood of the dimension at k neighbours; logs of 0 count as 0."""
    ln = F.when(F.col("dist") > 0, F.log("dist")).otherwise(0.0)
    e = edges.withColumn("ln", ln).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    num = F.sum(F.when(F.col("rank") == F.col("k"), (F.col("k") - 1) * F.col("ln")).otherwise(-F.col("ln")))
    return e.groupBy(F.col("src").alias("id"), "k").agg(num.alias("num"), F.first(F.col("k") - 1).cast("double").alias("den"))


def dimension(edges: DataFrame, ks: list[int] | None = None, stored: int | None = None) -> DataFrame:
    """(k, est): intrinsic dimension by maximum likelihood over all points, for each k."""
    ks = [k for k in (ks or NEIGHBOUR_SET) if stored is None or k <= stored]
    t = _terms(edges, ks).groupBy("k").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return t.select("k", F.when(F.col("num") != 0, F.col("den") / F.col("num")).otherwise(0.0).alias("est"))


def pointwise_ratio(edges: DataFrame, ks: list[int]) -> DataFrame:
    """(id, q): inverse dimension of each point over all k."""
    return _terms(edges, ks).groupBy("id").agg((F.sum("num") / F.sum("den")).alias("q"))


def windowed_dimension(edges: DataFrame, ks: list[int], window: int) -> DataFrame:
    """(id, est): dimension over each trailing window of points by id; the first windows that are not full are left out."""
    q = rekey(pointwise_ratio(edges, ks).select("id", "q"), "id", "n")
    # Each range of points has the last window - 1 points of the one before with it.
    step = max(WINDOW_ROWS, window)
    part = F.floor(F.col("n") / step)
    both = F.when(F.col("n") % step >= step - (window - 1), F.array(part, part + 1)).otherwise(F.array(part))
    w = W.partitionBy("part").orderBy("n").rowsBetween(-(window - 1), 0)
    q = q.withColumn("part", F.explode(both)).select("id", "part", F.floor(F.col("n") / step).alias("own"), F.sum("q").over(w).alias("s"), F.count("*").over(w).alias("full"))
    q = q.where((F.col("full") == window) & (F.col("part") == F.col("own")))
    return q.select("id", F.when(F.col("s") != 0, window / F.col("s")).otherwise(0.0).alias("est"))


def running_median(series: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """Adds ``median`` over a centred window of ``width`` rows of each key."""
    half = width // 2
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    return series.withColumn("median", F.percentile(value, 0.5).over(w))


def joint_pdf(labels: DataFrame, assignment: DataFrame) -> DataFrame:
    """(replicate, cluster, p): every replicate weighs the same; all pairs of labels, zeros included.

    Points whose cluster or replicate is null are left out before shares are taken, so p adds up to 1.
    """
    c = labels.join(assignment, "id").where("cluster IS NOT NULL AND replicate IS NOT NULL").groupBy("replicate", "cluster").count()
    r = c.withColumn("q", F.col("count") / F.sum("count").over(W.partitionBy("replicate")))
    n = r.select("replicate").distinct().agg(F.count("*").alias("n"))
    # Labels are few: the table of all their pairs is the result asked for.
    grid = c.select("replicate").distinct().crossJoin(c.select("cluster").distinct())
    p = grid.join(r, ["replicate", "cluster"], "left").crossJoin(F.broadcast(n))
    return p.select("replicate", "cluster", (F.coalesce("q", F.lit(0.0)) / F.col("n")).alias("p"))


def mutual_information(pdf: DataFrame) -> DataFrame:
    """(nmi): mutual information over joint entropy of (replicate, cluster, p)."""
    m = pdf.select("p", F.sum("p").over(W.partitionBy("replicate")).alias("r"), F.sum("p").over(W.partitionBy("cluster")).alias("c")).where("p > 0")
    s = m.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("r") * F.col("c")))).alias("mi"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return s.select(F.when(F.col("h") > 0, F.col("mi") / F.col("h")).otherwise(1.0).alias("nmi"))


def paste(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Columns e1, e2, .. of several estimates side by side by key."""
    out = tables[0].select(key, F.col(value).alias("e1"))
    for n, t in enumerate(tables[1:], 2):
        out = out.join(t.select(key, F.col(value).alias(f"e{n}")), key)
    return out


def downsample(df: DataFrame, row: Column, step: int = 100) -> DataFrame:
    """Every ``step``-th row (P10)."""
    return df.where(row % step == 0)
