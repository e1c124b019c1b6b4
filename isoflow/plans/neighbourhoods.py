"""Queries over neighbours and their graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph as g, knn as nn, sparse_index, stats
from ..operators.blocks import kept
from .inputs import GRAPH, K, K_SIGMA, KNN, LANDMARKS, ORACLE, PERPLEXITY, SIGMA, VEC, frames, query, r6, sparse_vectors, vectors

MEASURED = "SELECT src, dst, rank, round(dist, 6) + 0.0 AS dist FROM knn"


def measured(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "rank", r6("dist").alias("dist"))


def edges(spark, sf) -> DataFrame:
    return nn.knn(vectors(spark, sf), K)


def graph(spark, sf) -> DataFrame:
    # Bandwidths, affinities and degrees all read it.
    return kept(g.symmetric_graph(edges(spark, sf)))


def landmark_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph, bandwidths and affinities of the landmarks."""
    own = kept(g.symmetric_graph(nn.knn(vectors(spark, sf, 0), K)))
    s = g.local_sigma(own, K_SIGMA)
    return own, s, g.local_affinity(own, s)


def outside_edges(spark, sf) -> DataFrame:
    return g.directed_graph(nn.knn(vectors(spark, sf, 0), K, vectors(spark, sf, 1), exclude="none"))


@query(f"WITH {KNN} {MEASURED}")
def knn_euclidean(spark, sf):
    return measured(edges(spark, sf))


UNSOUND = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 <> 7 AND vec_id % 50 <> 8)"


def ranked_sql(vec: str, dist: str, pairs: str = "FROM vec a JOIN vec b ON a.id <> b.id", keep: str = f"rank <= {K}") -> str:
    return f"WITH {vec}, knn AS (SELECT a.id AS src, b.id AS dst, {dist} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS rank {pairs} QUALIFY {keep}) "


@query(ranked_sql(UNSOUND, "list_distance(a.v, b.v)") + MEASURED)
def knn_unsound(spark, sf):
    """Vectors of which some have a null component and some one that is not a number: they neither have neighbours nor are one."""
    bad = F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.lit(float("nan")))
    v = F.when((F.col("id") % 50).isin(7, 8), F.transform("v", lambda x, i: F.when(i == 3, bad).otherwise(x))).otherwise(F.col("v"))
    return measured(nn.knn(vectors(spark, sf).withColumn("v", v), K))


@query(ranked_sql("vec AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS v FROM embeddings)", "sqrt(greatest(0.0, (1 - list_cosine_similarity(a.v, b.v)) / 2))") + MEASURED)
def knn_correlation(spark, sf):
    return measured(nn.knn(vectors(spark, sf), K, metric="correlation"))


@query(ranked_sql("vec AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0.1 THEN x ELSE 0.0 END) AS v FROM embeddings)", "list_distance(a.v, b.v)") + MEASURED)
def knn_sparse(spark, sf):
    return measured(nn.knn_sparse(sparse_vectors(spark, sf), K))


@query(ORACLE["knn_sparse"])
def knn_sparse_indexed(spark, sf):
    return measured(sparse_index.knn_sparse_indexed(sparse_vectors(spark, sf), K))


@query(ranked_sql(VEC, "list_distance(a.v, b.v)", "FROM vec a JOIN vec b ON a.id % 2 = 1 AND b.id % 2 = 0", f"rank BETWEEN 2 AND {K + 1}") + "SELECT src, dst, rank - 1 AS rank, round(dist, 6) + 0.0 AS dist FROM knn")
def knn_rank0_excluded(spark, sf):
    return measured(nn.knn(vectors(spark, sf, 0), K, vectors(spark, sf, 1), exclude="rank0"))


@query(f"WITH {VEC} SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 6) + 0.0 AS dist FROM vec a JOIN vec b ON a.id % 2 = 0 AND b.id % 2 = 0")
def distance_matrix(spark, sf):
    return measured(nn.knn(vectors(spark, sf, 0), None, exclude="none")).drop("rank")


@query(f"WITH {VEC} SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 6) + 0.0 AS dist FROM vec a JOIN vec b ON true")
def distance_matrix_whole(spark, sf):
    return measured(nn.knn(vectors(spark, sf), None, exclude="none")).drop("rank")


@query()
def knn_rmsd_fitted(spark, sf):
    own = frames(spark, sf).select(F.col("frame").alias("id"), "coords")
    return measured(nn.knn_rmsd(own, K))


@query(f"WITH {KNN} SELECT src, dst, rank, round(dist, 6) + 0.0 AS dist FROM knn WHERE rank <= 4")
def knn_selected(spark, sf):
    return measured(g.select_knn(edges(spark, sf), 4))


@query(f"WITH {GRAPH} SELECT i, j, round(d, 6) + 0.0 AS d FROM g")
def symmetric_graph(spark, sf):
    return graph(spark, sf).select("i", "j", r6("d").alias("d"))


@query(f"WITH {KNN} SELECT src AS query, dst AS ref, round(dist, 6) + 0.0 AS w FROM knn UNION ALL SELECT dst, src, round(dist, 6) + 0.0 FROM knn WHERE (dst, src) NOT IN (SELECT (src, dst) FROM knn)")
def directed_graph(spark, sf):
    e = edges(spark, sf)
    return g.directed_graph(e, symmetric=True).select("query", "ref", r6("w").alias("w"))


@query(f"WITH {GRAPH} SELECT i AS id, count(*) AS n, round(sum(d), 6) + 0.0 AS total FROM m GROUP BY i")
def incident_edges(spark, sf):
    return g.mirrored(graph(spark, sf)).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), r6(F.sum("d")).alias("total"))


@query(f"WITH {GRAPH} SELECT i // 2 AS i, j // 2 AS j, round(d, 6) + 0.0 AS d FROM g WHERE i % 2 = 0 AND j % 2 = 0")
def subgraph(spark, sf):
    nodes = vectors(spark, sf, 0).select(F.col("id").alias("old"), (F.col("id") / 2).cast("long").alias("new"))
    return g.subgraph(graph(spark, sf), nodes).select("i", "j", r6("d").alias("d"))


@query(f"WITH {GRAPH} SELECT id, round(sigma, 6) + 0.0 AS sigma FROM s")
def sigma_nearest(spark, sf):
    return g.local_sigma(graph(spark, sf), K_SIGMA).select("id", r6("sigma").alias("sigma"))


@query(f"WITH {GRAPH} SELECT i AS id, round(sum(d) / {K_SIGMA}, 6) + 0.0 AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY j) AS n FROM m) WHERE n <= {K_SIGMA} GROUP BY i")
def sigma_by_index(spark, sf):
    return g.local_sigma(graph(spark, sf), K_SIGMA, order="index").select("id", r6("sigma").alias("sigma"))


@query(f"WITH {GRAPH} SELECT round(avg(sigma), 6) + 0.0 AS sigma FROM s")
def sigma_mean(spark, sf):
    return g.mean_sigma(g.local_sigma(graph(spark, sf), K_SIGMA)).select(r6("sigma").alias("sigma"))


@query(f"WITH {GRAPH} SELECT DISTINCT i AS id, round({PERPLEXITY}, 6) + 0.0 AS perplexity FROM m")
def sigma_entropic(spark, sf):
    """The bandwidths found are right if they have the perplexity asked for."""
    own = graph(spark, sf)
    return g.achieved_perplexity(own, g.entropic_sigma(own, K, PERPLEXITY), K).select("id", r6("perplexity").alias("perplexity"))


@query(f"WITH {GRAPH} SELECT i, j, round(exp(-d * d / (2 * {SIGMA}::DOUBLE * {SIGMA}::DOUBLE)), 6) + 0.0 AS w FROM g")
def affinity_fixed(spark, sf):
    return g.fixed_affinity(graph(spark, sf), SIGMA).select("i", "j", r6("w").alias("w"))


@query(f"WITH {GRAPH} SELECT i, j, round(w, 6) + 0.0 AS w FROM l")
def affinity_local(spark, sf):
    own = graph(spark, sf)
    return g.normalised(g.local_affinity(own, g.local_sigma(own, K_SIGMA))).select("i", "j", r6("w").alias("w"))


@query(f"WITH {GRAPH} SELECT id, round(degree, 6) + 0.0 AS degree FROM deg")
def degrees(spark, sf):
    own = graph(spark, sf)
    return g.degrees(g.local_affinity(own, g.local_sigma(own, K_SIGMA))).select("id", r6("degree").alias("degree"))


@query(f"WITH {LANDMARKS} SELECT query, ref, round(w, 6) + 0.0 AS w FROM ol")
def affinity_outside(spark, sf):
    _, s, a = landmark_parts(spark, sf)
    out = g.normalised_outside(g.outside_affinity(outside_edges(spark, sf), s), g.degrees(a))
    return out.select("query", "ref", r6("w").alias("w"))


@query(f"WITH {GRAPH} SELECT i AS id, round(sum(w * (j % 7)), 6) + 0.0 AS value FROM (SELECT i, j, w FROM l UNION ALL SELECT j, i, w FROM l) GROUP BY i")
def multiply_symmetric(spark, sf):
    own = graph(spark, sf)
    a = g.normalised(g.local_affinity(own, g.local_sigma(own, K_SIGMA)))
    v = vectors(spark, sf).select("id", (F.col("id") % 7).cast("double").alias("value"))
    return g.multiply(a, v).select("id", r6("value").alias("value"))


@query(f"WITH {LANDMARKS} SELECT query AS id, round(sum(w * (ref % 7)), 6) + 0.0 AS value FROM o GROUP BY query")
def multiply_outside(spark, sf):
    v = vectors(spark, sf, 0).select("id", (F.col("id") % 7).cast("double").alias("value"))
    return g.multiply_outside(outside_edges(spark, sf), v).select("id", r6("value").alias("value"))


KERNEL = f"{KNN}, sd AS (SELECT stddev_samp(dist) AS s FROM knn), k AS (SELECT src AS id, sum(exp(-dist * dist / (2 * s * s))) AS x FROM knn, sd GROUP BY src)"


@query(f"WITH {KERNEL} SELECT id, round(x / {K}, 6) + 0.0 AS value FROM k")
def density(spark, sf):
    return stats.density(edges(spark, sf), K).select("id", r6("value").alias("value"))


@query(f"WITH {KERNEL} SELECT id, round(x / sum(x) OVER (), 6) + 0.0 AS value FROM k")
def probability(spark, sf):
    return stats.probability(edges(spark, sf)).select("id", r6("value").alias("value"))


@query(f"WITH {KERNEL} SELECT src AS id, round(-sum(log2(x / {K})) / {K}, 6) + 0.0 AS value FROM knn JOIN k ON k.id = dst GROUP BY src")
def entropy(spark, sf):
    e = edges(spark, sf)
    return stats.entropy(e, stats.density(e, K), K).select("id", r6("value").alias("value"))


TERMS = f"""{KNN}, t AS (
  SELECT src AS id, k, sum(CASE WHEN rank = k THEN (k - 1) * x ELSE -x END) AS num, (k - 1)::DOUBLE AS den
  FROM (SELECT src, rank, CASE WHEN dist > 0 THEN ln(dist) ELSE 0 END AS x FROM knn), (SELECT unnest([2, 3, 4, 6, 8]) AS k) WHERE rank <= k GROUP BY src, k
)"""


@query(f"WITH {TERMS} SELECT k, round(CASE WHEN sum(num) <> 0 THEN sum(den) / sum(num) ELSE 0 END, 6) + 0.0 AS est FROM t GROUP BY k")
def dimension(spark, sf):
    return stats.dimension(edges(spark, sf), stored=K).select("k", r6("est").alias("est"))


WIDE = TERMS.replace(f"rank <= {K}\n", "rank <= 40\n").replace("[2, 3, 4, 6, 8]", "[2, 3, 4, 6, 8, 16, 32]")


@query(f"WITH {WIDE} SELECT k, round(CASE WHEN sum(num) <> 0 THEN sum(den) / sum(num) ELSE 0 END, 6) + 0.0 AS est FROM t GROUP BY k")
def dimension_forty(spark, sf):
    """The default neighbour counts up to 40 neighbours."""
    return stats.dimension(nn.knn(vectors(spark, sf), 40), stored=40).select("k", r6("est").alias("est"))


@query(f"WITH {TERMS}, q AS (SELECT id, sum(num) / sum(den) AS q FROM t GROUP BY id), w AS (SELECT id, sum(q) OVER w AS s, count(*) OVER w AS n FROM q WINDOW w AS (ORDER BY id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) SELECT id, round(CASE WHEN s <> 0 THEN 25 / s ELSE 0 END, 5) + 0.0 AS est FROM w WHERE n = 25")
def dimension_windowed(spark, sf):
    return stats.windowed_dimension(edges(spark, sf), [2, 3, 4, 6, 8], 25).select("id", (F.round("est", 5) + 0.0).alias("est"))


@query(f"WITH {TERMS}, e AS (SELECT k, round(CASE WHEN sum(num) <> 0 THEN sum(den) / sum(num) ELSE 0 END, 6) + 0.0 AS est FROM t GROUP BY k) SELECT k, est AS e1, est AS e2 FROM e WHERE k > 2")
def paste(spark, sf):
    e = stats.dimension(edges(spark, sf), stored=K).select("k", r6("est").alias("est"))
    return stats.paste([e, e.where("k > 2")], "k", "est")
