"""Queries over spectra, scalings, paths and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cluster, graph as g, knn as nn, mixture, paths, spectral
from ..operators.blocks import kept
from .inputs import GRAPH, K, K_SIGMA, LANDMARKS, SIGMA, VEC, query, r6, vectors
from .neighbourhoods import graph, outside_edges


def spectrum(spark, sf, n: int = 4) -> tuple[DataFrame, DataFrame]:
    return spectral.decompose(graph(spark, sf), n, k_sigma=K_SIGMA)


def points(spark, sf, dims: int = 4) -> DataFrame:
    return cluster.coordinates(spectrum(spark, sf, dims)[1], dims)


@query("SELECT k::INT AS k, true AS converged FROM range(1, 5) t(k)")
def eigen_residuals(spark, sf):
    return spectrum(spark, sf)[0].select("k", "converged")


@query(f"WITH {GRAPH} SELECT id, round(sqrt(degree / sum(degree) OVER ()), 6) + 0.0 AS value FROM deg")
def leading_eigenvector(spark, sf):
    """Of a connected graph it is the root of the degrees, with eigenvalue 1."""
    return spectrum(spark, sf)[1].where("k = 1").select("id", r6("value").alias("value"))


@query(f"WITH {LANDMARKS}, v AS (SELECT id, sqrt(degree / sum(degree) OVER ()) AS v FROM deg) SELECT query AS id, round(sum(w * v), 6) + 0.0 AS value FROM ol JOIN v ON v.id = ref GROUP BY query")
def extended_eigenvector(spark, sf):
    own = kept(g.symmetric_graph(nn.knn(vectors(spark, sf, 0), K)))
    out = spectral.decompose_outside(own, outside_edges(spark, sf), 2, k_sigma=K_SIGMA)[2]
    return out.where("k = 1").select("id", r6("value").alias("value"))


FIXED = f"""{GRAPH}, fa AS (
  SELECT i, j, exp(-d * d / (2 * {SIGMA} * {SIGMA})) AS w FROM g
), fdeg AS (
  SELECT i AS id, sum(w) AS degree FROM (SELECT i, w FROM fa UNION ALL SELECT j, w FROM fa) GROUP BY i
)"""


@query(f"WITH {FIXED} SELECT id, round(sqrt(degree / sum(degree) OVER ()), 6) + 0.0 AS value FROM fdeg")
def leading_eigenvector_fixed(spark, sf):
    """With one bandwidth for all points, by the block method; exact enough for six decimals to agree near a tie."""
    m = g.normalised(g.fixed_affinity(graph(spark, sf), SIGMA))
    return spectral.block_eigs(m, 1, aim=1e-13)[1].select("id", r6("value").alias("value"))


@query(f"""WITH {LANDMARKS}, fa AS (
  SELECT i, j, exp(-d * d / (2 * {SIGMA} * {SIGMA})) AS w FROM g
), fdeg AS (
  SELECT i AS id, sum(w) AS degree FROM (SELECT i, w FROM fa UNION ALL SELECT j, w FROM fa) GROUP BY i
), fo AS (
  SELECT query, ref, exp(-w * w / (2 * {SIGMA} * {SIGMA})) AS w FROM o
), fl AS (
  SELECT query, ref, w / sqrt(degree * sum(w) OVER (PARTITION BY query)) AS w FROM fo JOIN fdeg ON fdeg.id = ref
), v AS (
  SELECT id, sqrt(degree / sum(degree) OVER ()) AS v FROM fdeg
)
SELECT query AS id, round(sum(w * v), 6) + 0.0 AS value FROM fl JOIN v ON v.id = ref GROUP BY query""")
def extended_eigenvector_fixed(spark, sf):
    own = kept(g.symmetric_graph(nn.knn(vectors(spark, sf, 0), K)))
    out = spectral.decompose_outside(own, outside_edges(spark, sf), 2, sigma=SIGMA)[2]
    return out.where("k = 1").select("id", r6("value").alias("value"))


@query()
def eigen_pairs(spark, sf):
    """The four largest eigenvalues by the block method, with their vectors' Rayleigh quotients and residuals taken anew from the matrix."""
    own = graph(spark, sf)
    m = g.normalised(g.local_affinity(own, g.local_sigma(own, K_SIGMA)))
    values, vecs = spectral.block_eigs(m, 4)
    both = g.mirrored(m, "w").join(vecs.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id"), "k").agg(F.sum(F.col("w") * F.col("value")).alias("image"))
    at = vecs.join(both, ["id", "k"]).join(F.broadcast(values.select("k", "eigenvalue")), "k")  # four rows
    gap = F.col("image") - F.col("eigenvalue") * F.col("value")
    sums = at.groupBy("k").agg(F.max("eigenvalue").alias("eigenvalue"), F.sum(F.col("image") * F.col("value")).alias("rayleigh"), F.sqrt(F.sum(gap * gap)).alias("residual"), F.sum(F.col("value") * F.col("value")).alias("norm2"))
    return sums.select("k", *(r6(c).alias(c) for c in ("eigenvalue", "rayleigh", "residual", "norm2")))


def all_distances(spark, sf, part: int | None = 0) -> DataFrame:
    e = nn.knn(vectors(spark, sf, part), None, exclude="none")
    return e.where("src <= dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("d"))


CENTRED_SQL = f"""{VEC}, q AS (
  SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) ** 2 AS q FROM vec a JOIN vec b ON a.id % 2 = 0 AND b.id % 2 = 0
), m AS (
  SELECT i, avg(q) AS m FROM q GROUP BY i
), b AS (
  SELECT q.i, q.j, -0.5::DOUBLE * (q - x.m - y.m + (SELECT avg(q) FROM q)) AS b FROM q JOIN m x ON x.i = q.i JOIN m y ON y.i = q.j
)"""


@query(f"WITH {CENTRED_SQL} SELECT i, j, round(b, 6) + 0.0 AS b FROM b WHERE i <= j")
def double_centred(spark, sf):
    return spectral.double_centred(all_distances(spark, sf)).select("i", "j", r6("b").alias("b"))


WHOLE_SQL = CENTRED_SQL.replace("ON a.id % 2 = 0 AND b.id % 2 = 0", "ON true")


@query(f"WITH {WHOLE_SQL} SELECT i, j, round(b, 6) + 0.0 AS b FROM b WHERE i <= j")
def double_centred_whole(spark, sf):
    return spectral.double_centred(all_distances(spark, sf, None)).select("i", "j", r6("b").alias("b"))


@query(f"WITH {VEC} SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 4) + 0.0 AS dist FROM vec a JOIN vec b ON b.id = a.id + 1")
def scaled_distances(spark, sf):
    """Distance of each vector to the next by the coordinates that landmarks, a fifth of the vectors, give to all."""
    every = vectors(spark, sf)
    own, rest = every.where("id % 5 = 0"), every.where("id % 5 <> 0")
    d = nn.knn(own, None, exclude="none").where("src <= dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("d"))
    far = nn.knn(own, None, rest, exclude="none").select(F.col("src").alias("query"), F.col("dst").alias("ref"), F.col("dist").alias("w"))
    x = spectral.landmark_scaling(d, far, 64)[1]
    y = x.select((F.col("id") - 1).alias("id"), "k", F.col("value").alias("other"))
    gap = F.col("value") - F.col("other")
    return x.join(y, ["id", "k"]).groupBy(F.col("id").alias("src")).agg((F.round(F.sqrt(F.sum(gap * gap)), 4) + F.lit(0.0)).alias("dist")).select("src", (F.col("src") + 1).alias("dst"), "dist")


@query(f"WITH {CENTRED_SQL} SELECT i AS id, round(b, 6) + 0.0 AS norm2 FROM b WHERE i = j")
def classical_scaling(spark, sf):
    """Squared lengths of the coordinates, which are the diagonal of the centred matrix."""
    _, x = spectral.classical_scaling(all_distances(spark, sf), 64)
    return x.groupBy("id").agg(r6(F.sum(F.col("value") * F.col("value"))).alias("norm2"))


@query(f"WITH RECURSIVE {GRAPH}, r(i, j, x, n) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM vec WHERE id < 5 UNION ALL SELECT i, j, min(x), n FROM (SELECT r.i, m.j, r.x + m.d AS x, r.n + 1 AS n FROM r JOIN m ON m.i = r.j WHERE r.n < 3) GROUP BY i, j, n) SELECT i, j, round(min(x), 6) + 0.0 AS d FROM r GROUP BY i, j")
def hop_paths(spark, sf):
    src = vectors(spark, sf).where("id < 5").select("id")
    return paths.hop_paths(graph(spark, sf), src, 3).select("i", "j", r6("d").alias("d"))


@query(f"""WITH RECURSIVE {GRAPH}, r(i, j, x, n) AS (
  SELECT id, id, 0.0::DOUBLE, 0 FROM vec
  UNION ALL SELECT i, j, min(x), n FROM (SELECT r.i, m.j, r.x + m.d AS x, r.n + 1 AS n FROM r JOIN m ON m.i = r.j WHERE r.n < 40) GROUP BY i, j, n
), least_path AS (
  SELECT i, j, min(x) AS d FROM r GROUP BY i, j
)
SELECT a.id AS i, b.id AS j, round(d, 6) + 0.0 AS d FROM vec a JOIN vec b ON a.id <= b.id LEFT JOIN least_path p ON p.i = a.id AND p.j = b.id""")
def shortest_paths(spark, sf):
    return paths.all_pairs(graph(spark, sf)).select("i", "j", r6("d").alias("d"))


@query()
def geodesic_scaling(spark, sf):
    """Scaling of shortest paths: eigenvalues of the two leading coordinates."""
    values, _ = spectral.geodesic_scaling(graph(spark, sf), 2)
    return values.select("k", r6("eigenvalue").alias("eigenvalue"))


@query()
def spectral_kmeans(spark, sf):
    return cluster.kmeans(points(spark, sf), 4)


@query()
def spectral_mixture(spark, sf):
    return cluster.gaussian_mixture(points(spark, sf), 3).select("id", "cluster", r6("uncertainty").alias("uncertainty"))


@query()
def spectral_kmeans_exchange(spark, sf):
    """Clusters that no move of a single point would improve."""
    return mixture.exchange_kmeans(points(spark, sf), 4, starts=3)


@query()
def spectral_mixture_family(spark, sf):
    """The mixture whose covariance family has the largest BIC."""
    out, family, _ = mixture.mixture(points(spark, sf), 3)
    return out.select("id", "cluster", r6("uncertainty").alias("uncertainty"), F.lit(family).alias("family"))


@query()
def spectral_bisection(spark, sf):
    return spectral.bisect(spark, graph(spark, sf), sigma=0.5)
