"""Inputs of the registered queries as views of the tables, in Spark and as SQL, and the list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Neighbours, bandwidth neighbours, bandwidth and perplexity of the registered queries.
K, K_SIGMA, SIGMA, PERPLEXITY = 10, 5, 0.5, 6.0


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Six decimals, never -0: sums differ in their last bits between engines."""
    return F.round(x, 6) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, part: int | None = None) -> DataFrame:
    """(id, v): all vectors, or those with an even (0, the landmarks) or odd id (1)."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return d if part is None else d.where(F.col("id") % 2 == part)


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, val): the components above 0.1."""
    d = vectors(spark, sf_dir).select("id", F.array_compact(F.transform("v", lambda x, i: F.when(x > 0.1, F.struct(i.alias("i"), x.alias("x"))))).alias("s"))
    return d.select("id", F.transform("s", lambda e: e["i"]).alias("idx"), F.transform("s", lambda e: e["x"]).alias("val"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, time, prec, coords): 21 points from the first 63 components of each vector."""
    d = vectors(spark, sf_dir)
    coords = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda a: F.slice("v", 3 * a + 1, 3))
    return d.select(F.col("id").alias("frame"), (F.col("id") * 0.5).alias("time"), F.lit(1000.0).alias("prec"), coords.alias("coords"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster): place of the largest component modulo 5."""
    v = F.col("v")
    return vectors(spark, sf_dir).select("id", (F.array_position(v, F.array_max(v)) % 5).cast("int").alias("cluster"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, replicate) from the label of the table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).cast("int").alias("replicate"))


VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
KNN = f"""{VEC}, knn AS (
  SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM vec a JOIN vec b ON a.id <> b.id QUALIFY rank <= {K}
)"""


def graph_sql(knn: str = KNN) -> str:
    return f"""{knn}, g AS (
  SELECT least(src, dst) AS i, greatest(src, dst) AS j, arg_max(dist, src) AS d FROM knn GROUP BY ALL
), m AS (
  SELECT i, j, d FROM g UNION ALL SELECT j, i, d FROM g
), s AS (
  SELECT i AS id, sum(d) / {K_SIGMA} AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM m) WHERE n <= {K_SIGMA} GROUP BY i
), a AS (
  SELECT g.i, g.j, exp(-d * d / (2 * x.sigma * y.sigma)) AS w FROM g JOIN s x ON x.id = g.i JOIN s y ON y.id = g.j
), deg AS (
  SELECT i AS id, sum(w) AS degree FROM (SELECT i, w FROM a UNION ALL SELECT j, w FROM a) GROUP BY i
), l AS (
  SELECT a.i, a.j, w / sqrt(x.degree * y.degree) AS w FROM a JOIN deg x ON x.id = a.i JOIN deg y ON y.id = a.j
)"""


GRAPH = graph_sql()
#: The same of the landmarks only, and the landmarks' distances to the K nearest of each other vector.
LANDMARKS = graph_sql(
    f"""{VEC}, even AS (SELECT * FROM vec WHERE id % 2 = 0), odd AS (SELECT * FROM vec WHERE id % 2 = 1), knn AS (
  SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM even a JOIN even b ON a.id <> b.id QUALIFY rank <= {K}
)"""
) + f""", o AS (
  SELECT a.id AS query, b.id AS ref, list_distance(a.v, b.v) AS w, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM odd a JOIN even b ON true QUALIFY rank <= {K}
), oa AS (
  SELECT query, ref, exp(-w * w / (2 * sigma * sigma)) AS w FROM o JOIN s ON s.id = ref
), ol AS (
  SELECT query, ref, w / sqrt(degree * sum(w) OVER (PARTITION BY query)) AS w FROM oa JOIN deg ON deg.id = ref
)"""
TRAJ = "traj AS (SELECT vec_id AS frame, list_transform(range(0, 21), lambda a: (embedding::DOUBLE[])[3 * a + 1 : 3 * a + 3]) AS c FROM embeddings)"
CENTRED = f"""{TRAJ}, mean AS (
  SELECT frame, c, list_transform(range(1, 4), lambda k: list_sum(list_transform(c, lambda p: p[k])) / 21) AS o FROM traj
), cen AS (
  SELECT frame, list_transform(c, lambda p: [p[1] - o[1], p[2] - o[2], p[3] - o[3]]) AS c, flatten(list_transform(c, lambda p: [p[1] - o[1], p[2] - o[2], p[3] - o[3]])) AS flat FROM mean
)"""
LABELS = "lab AS (SELECT vec_id AS id, (list_position(embedding, list_max(embedding)) % 5)::INT AS cluster, (label + 1)::INT AS replicate FROM embeddings)"
