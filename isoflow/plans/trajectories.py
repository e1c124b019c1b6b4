"""Queries over frames, series and labels."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import geometry as geo
from ..operators import cluster, stats, trajectory as tr
from .inputs import CENTRED, LABELS, TRAJ, VEC, assignment, frames, labels, query, r6, table, vectors


@query("SELECT count(*) AS n_frames, 21 AS n_atoms, min(vec_id) * 0.5::DOUBLE AS start_time, max(vec_id) * 0.5::DOUBLE AS end_time, 1000.0::DOUBLE AS prec FROM embeddings")
def frame_summary(spark, sf):
    return tr.summary(frames(spark, sf))


@query("SELECT vec_id AS id, row_number() OVER (PARTITION BY vec_id % 4 = 0 ORDER BY vec_id) - 1 AS frame, vec_id % 4 = 0 AS landmark FROM embeddings")
def frame_split(spark, sf):
    """Every fourth frame a landmark; both sides numbered anew."""
    parts = tr.split(frames(spark, sf).select("frame", F.col("frame").alias("id")), 4)
    a, b = (tr.rekey(p).select("id", "frame", F.lit(x).alias("landmark")) for p, x in zip(parts, (True, False)))
    return a.unionByName(b)


@query(f"WITH {CENTRED}, u AS (SELECT frame, unnest(range(0, 21)) AS atom, c FROM cen) SELECT frame, atom, round(c[atom + 1][1], 6) + 0.0 AS x, round(c[atom + 1][2], 6) + 0.0 AS y, round(c[atom + 1][3], 6) + 0.0 AS z FROM u")
def frame_centred(spark, sf):
    d = frames(spark, sf).select("frame", F.posexplode(tr.centred(F.col("coords"))).alias("atom", "p"))
    return d.select("frame", F.col("atom").cast("long").alias("atom"), *(r6(F.col("p")[k]).alias(n) for k, n in enumerate("xyz")))


@query(f"WITH {TRAJ} SELECT frame, " + ", ".join(f"round((c[1][{k}] + 2 * c[2][{k}] + 3 * c[4][{k}]) / 6, 6) + 0.0 AS {n}" for k, n in enumerate("xyz", 1)) + " FROM traj")
def centre_of_mass(spark, sf):
    """Atoms 0, 1 and 3 with masses 1, 2 and 3."""
    c = tr.centre_of_mass(F.col("coords"), [1.0, 2.0, 1.0, 3.0], [0, 1, 3])
    return frames(spark, sf).select("frame", *(r6(c[k]).alias(n) for k, n in enumerate("xyz")))


def torsions_sql(places: str) -> str:
    return f"""q AS (
  SELECT frame, n, c[x + 1] AS a, c[x + 2] AS b, c[x + 3] AS d, c[x + 4] AS e FROM (SELECT frame, c, unnest({places}) AS x, unnest(range(0, len({places}))) AS n FROM traj)
), b AS (
  SELECT frame, n, [b[1] - a[1], b[2] - a[2], b[3] - a[3]]::DOUBLE[3] AS b1, [d[1] - b[1], d[2] - b[2], d[3] - b[3]]::DOUBLE[3] AS b2, [e[1] - d[1], e[2] - d[2], e[3] - d[3]]::DOUBLE[3] AS b3 FROM q
), x AS (
  SELECT frame, n, b2, array_cross_product(b1, b2) AS n1, array_cross_product(b2, b3) AS n2 FROM b
), y AS (
  SELECT frame, n, b2, n1, n2, sqrt(array_inner_product(n1, n1)) * sqrt(array_inner_product(n2, n2)) AS size FROM x
), tors AS (
  SELECT frame, n, CASE WHEN size > 0 THEN acos(greatest(-1.0, least(1.0, array_inner_product(n1, n2) / size))) * CASE WHEN array_inner_product(array_cross_product(n1, n2), b2) < 0 THEN -1 ELSE 1 END END AS angle FROM y
)"""


BACKBONE = torsions_sql("list_filter(range(0, 18), lambda x: x % 3 <> 1)")


@query(f"WITH {TRAJ}, {BACKBONE} SELECT frame, n, round(angle, 6) + 0.0 AS angle FROM tors")
def backbone_torsions(spark, sf):
    d = frames(spark, sf).select("frame", F.posexplode(geo.backbone_torsions(F.col("coords"))).alias("n", "a"))
    return d.select("frame", F.col("n").cast("long").alias("n"), r6("a").alias("angle"))


@query(f"""WITH {TRAJ}, {torsions_sql("range(0, 18)")}, th AS (
  SELECT frame, n, c[n + 1] AS a, c[n + 2] AS b, c[n + 3] AS d FROM (SELECT frame, c, unnest(range(0, 19)) AS n FROM traj)
), lr AS (
  SELECT frame, n, [a[1] - b[1], a[2] - b[2], a[3] - b[3]]::DOUBLE[3] AS l, [d[1] - b[1], d[2] - b[2], d[3] - b[3]]::DOUBLE[3] AS r FROM th
), al AS (
  SELECT frame, n, acos(greatest(-1.0, least(1.0, -array_inner_product(l, r) / (sqrt(array_inner_product(l, l)) * sqrt(array_inner_product(r, r)))))) AS angle FROM lr
  UNION ALL SELECT frame, n + 19, angle FROM tors
) SELECT frame, n, round(angle, 6) + 0.0 AS angle FROM al""")
def alpha_angles(spark, sf):
    d = frames(spark, sf).select("frame", F.posexplode(geo.alpha_angles(F.col("coords"))).alias("n", "a"))
    return d.select("frame", F.col("n").cast("long").alias("n"), r6("a").alias("angle"))


@query(f"WITH {TRAJ}, {BACKBONE} SELECT frame, 2 * n + k AS n, round(CASE WHEN k = 0 THEN sin(angle) ELSE cos(angle) END, 6) + 0.0 AS value FROM tors, (SELECT unnest([0, 1]) AS k)")
def sincos(spark, sf):
    d = frames(spark, sf).select("frame", F.posexplode(geo.sincos(geo.backbone_torsions(F.col("coords")))).alias("n", "x"))
    return d.select("frame", F.col("n").cast("long").alias("n"), r6("x").alias("value"))


@query()
def smooth_amplitude(spark, sf):
    angles = frames(spark, sf).select("frame", geo.backbone_torsions(F.col("coords")).alias("v"))
    d = tr.smooth_angles(angles, 10.0, "amplitude").select("frame", F.posexplode("v").alias("n", "x"))
    return d.select("frame", "n", r6("x").alias("angle"))


@query(f"""WITH {TRAJ}, {BACKBONE}, t AS (
  SELECT frame, row_number() OVER (PARTITION BY n ORDER BY frame) - 1 AS t, n, angle FROM tors
), size AS (
  SELECT count(*) AS size, round_even(count(*) * (1 - 0.9::DOUBLE) / 2, 0)::BIGINT AS low FROM traj
), bin AS (
  SELECT unnest(range(0, size)) AS b, size, low FROM size
), held AS (
  SELECT b, size FROM bin WHERE b = 0 OR b < low OR b >= size - low
), kernel AS (
  SELECT x.b AS gap, sum(cos(2 * pi() * ((x.b * held.b) % held.size) / held.size)) AS c, sum(sin(2 * pi() * ((x.b * held.b) % held.size) / held.size)) AS s FROM bin x, held GROUP BY x.b
), z AS (
  SELECT a.frame, a.n, sum(cos(b.angle) * c - sin(b.angle) * s) AS re, sum(cos(b.angle) * s + sin(b.angle) * c) AS im
  FROM t a JOIN t b ON a.n = b.n JOIN kernel ON gap = (a.t - b.t + (SELECT size FROM size)) % (SELECT size FROM size) GROUP BY a.frame, a.n
)
SELECT frame, n::INT AS n, round(CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END, 6) + 0.0 AS angle FROM z""")
def smooth_frequency(spark, sf):
    angles = frames(spark, sf).select("frame", geo.backbone_torsions(F.col("coords")).alias("v"))
    d = tr.smooth_angles(angles, 90.0, "frequency").select("frame", F.posexplode("v").alias("n", "x"))
    return d.select("frame", "n", r6("x").alias("angle"))


@query(f"WITH {TRAJ}, p AS (SELECT frame, c, unnest(range(0, 21)) AS i FROM traj), q AS (SELECT frame, c, i, unnest(range(0, 21)) AS j FROM p) SELECT frame, i * 21 + j AS feature FROM q WHERE list_distance(c[i + 1], c[j + 1]) * 10 < 1.5")
def contacts(spark, sf):
    return tr.contacts(frames(spark, sf), epsilon=1.5).select("frame", F.explode("idx").alias("feature")).select("frame", F.col("feature").cast("long").alias("feature"))


@query(f"WITH {TRAJ}, p AS (SELECT frame, c, unnest(range(0, 21)) AS i FROM traj), q AS (SELECT frame, c, i, unnest(range(0, 21)) AS j FROM p) SELECT frame, i AS a, j AS b FROM q WHERE list_distance(c[i + 1], c[j + 1]) * 10 < 1.5")
def contact_pairs(spark, sf):
    """The same contacts by a join of grid cells, for structures that no row holds."""
    atoms = frames(spark, sf).select("frame", F.posexplode("coords").alias("atom", "p"))
    atoms = atoms.select("frame", F.col("atom").cast("long").alias("atom"), *(F.col("p")[k].alias(c) for k, c in enumerate("xyz")))
    return tr.contact_pairs(atoms, epsilon=1.5)


@query(f"WITH {CENTRED}, z AS (SELECT flat AS r FROM cen WHERE frame = 0) SELECT frame, round(list_distance(flat, r) / sqrt(21) * 10, 6) + 0.0 AS rmsd FROM cen, z")
def rmsd_unfitted(spark, sf):
    ref = frames(spark, sf).where("frame = 0").first().coords  # one frame
    return tr.rmsd_to(frames(spark, sf), ref, fit=False).select("frame", r6("rmsd").alias("rmsd"))


@query()
def rmsd_fitted(spark, sf):
    ref = frames(spark, sf).where("frame = 0").first().coords
    return tr.rmsd_to(frames(spark, sf), ref).select("frame", "time", r6("rmsd").alias("rmsd"))


@query(f"WITH {VEC} SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 6) + 0.0 AS euclid, round(sqrt(greatest(0.0, (1 - list_cosine_similarity(list_transform(a.v, lambda x: x - list_avg(a.v)), list_transform(b.v, lambda x: x - list_avg(b.v)))) / 2)), 6) + 0.0 AS corr FROM vec a JOIN vec b ON b.id = a.id + 1")
def vector_distances(spark, sf):
    """Scalar distances of each vector to the next."""
    a = vectors(spark, sf).select(F.col("id").alias("src"), F.col("v").alias("x"))
    b = vectors(spark, sf).select(F.col("id").alias("dst"), F.col("v").alias("y"))
    d = a.join(b, F.col("dst") == F.col("src") + 1)
    return d.select("src", "dst", r6(geo.euclidean(F.col("x"), F.col("y"))).alias("euclid"), r6(geo.correlation_distance(F.col("x"), F.col("y"))).alias("corr"))


@query(f"WITH {VEC} SELECT a.id AS src, round(list_distance(list_transform(a.v, lambda x: CASE WHEN x > 0.1 THEN x ELSE 0 END), list_transform(b.v, lambda x: CASE WHEN x > 0.1 THEN x ELSE 0 END)), 6) + 0.0 AS dist FROM vec a JOIN vec b ON b.id = a.id + 1")
def map_distances(spark, sf):
    """Distances of sparse vectors held as maps."""
    m = F.map_from_entries(F.array_compact(F.transform("v", lambda x, i: F.when(x > 0.1, F.struct(i.alias("k"), x.alias("x"))))))
    d = vectors(spark, sf).select("id", m.alias("m"))
    b = d.select(F.col("id").alias("b"), F.col("m").alias("n"))
    return d.join(b, F.col("b") == F.col("id") + 1).select(F.col("id").alias("src"), r6(geo.sparse_euclidean(F.col("m"), F.col("n"))).alias("dist"))


@query("SELECT vec_id AS frame, CASE WHEN vec_id % 2 = 1 THEN 11 ELSE vec_id // 100 + 1 END AS replicate FROM embeddings")
def replicates(spark, sf):
    d = tr.replicates(frames(spark, sf).select("frame"), 100, out_of_sample=F.col("frame") % 2 == 1, outside=11)
    return d.select("frame", "replicate")


@query("SELECT count(*)::BIGINT AS n, true AS within FROM (SELECT vec_id FROM embeddings LIMIT 50)")
def sample(spark, sf):
    """Fifty rows without replacement, each a row of the table."""
    d = tr.sample(frames(spark, sf).select("frame"), 50, "frame")
    return d.agg(F.countDistinct("frame").alias("n"), F.min(F.col("frame") >= 0).alias("within"))


@query("SELECT vec_id AS frame FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 50")
def sample_by_digest(spark, sf):
    """Fifty rows that any engine with MD5 draws alike."""
    return tr.sample(frames(spark, sf).select("frame"), 50, "frame", digest="md5")


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = 0")
def downsample(spark, sf):
    d = table(spark, sf, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return stats.downsample(d, F.col("n"), 10).select("event_id", "user_id", "value")


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) + 0.0 AS median FROM events")
def running_median(spark, sf):
    d = stats.running_median(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 11)
    return d.select("event_id", r6("median").alias("median"))


@query(f"WITH {LABELS} SELECT id, cluster FROM lab WHERE cluster = 3")
def label_select(spark, sf):
    return labels(spark, sf).where("cluster = 3")


PDF = f"""{LABELS}, c AS (
  SELECT replicate, cluster, count(*) AS n FROM lab GROUP BY ALL
), q AS (
  SELECT replicate, cluster, n / sum(n) OVER (PARTITION BY replicate) AS q FROM c
), p AS (
  SELECT r.replicate, k.cluster, coalesce(q.q, 0) / (SELECT count(DISTINCT replicate) FROM c) AS p
  FROM (SELECT DISTINCT replicate FROM c) r CROSS JOIN (SELECT DISTINCT cluster FROM c) k LEFT JOIN q ON q.replicate = r.replicate AND q.cluster = k.cluster
)"""


@query(f"WITH {PDF} SELECT replicate, cluster, round(p, 6) + 0.0 AS p FROM p")
def joint_pdf(spark, sf):
    return stats.joint_pdf(labels(spark, sf), assignment(spark, sf)).select("replicate", "cluster", r6("p").alias("p"))


@query(f"WITH {PDF}, m AS (SELECT p, sum(p) OVER (PARTITION BY replicate) AS r, sum(p) OVER (PARTITION BY cluster) AS c FROM p) SELECT round(sum(p * log2(p / (r * c))) / -sum(p * log2(p)), 6) + 0.0 AS nmi FROM m WHERE p > 0")
def mutual_information(spark, sf):
    return stats.mutual_information(stats.joint_pdf(labels(spark, sf), assignment(spark, sf))).select(r6("nmi").alias("nmi"))


@query(f"WITH {LABELS}, o AS (SELECT cluster, row_number() OVER (ORDER BY quantile_cont(id, 0.5), min(id))::INT AS n FROM lab GROUP BY cluster) SELECT id, n AS cluster FROM lab JOIN o USING (cluster)")
def canonical_labels(spark, sf):
    return cluster.canonical_labels(labels(spark, sf))


@query(f"WITH {LABELS} SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS percent FROM lab GROUP BY cluster")
def cluster_shares(spark, sf):
    return cluster.shares(labels(spark, sf)).select("cluster", "n", r6("percent").alias("percent"))


@query(f"WITH {LABELS}, u AS (SELECT vec_id AS id, abs(embedding[1]::DOUBLE) AS uncertainty FROM embeddings) SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS percent, round(avg(uncertainty), 6) + 0.0 AS uncertainty FROM lab JOIN u USING (id) GROUP BY cluster")
def cluster_uncertainty(spark, sf):
    """Shares with the mean uncertainty of each cluster; a component of the vector stands for a point's."""
    u = vectors(spark, sf).select("id", F.abs(F.col("v")[0]).alias("uncertainty"))
    return cluster.shares(labels(spark, sf).join(u, "id")).select("cluster", "n", *(r6(c).alias(c) for c in ("percent", "uncertainty")))


MEANS = f"""{LABELS}, {VEC}, mean AS (
  SELECT cluster, k, avg(v[k]) AS x FROM (SELECT cluster, v, unnest(range(1, 65)) AS k FROM vec JOIN lab USING (id)) GROUP BY cluster, k
), cen AS (
  SELECT cluster, list(x ORDER BY k) AS c FROM mean GROUP BY cluster
)"""


@query(f"WITH {MEANS} SELECT cluster, k - 1 AS n, round(x, 6) + 0.0 AS x FROM mean")
def cluster_means(spark, sf):
    d = cluster.centroids(vectors(spark, sf), labels(spark, sf)).select("cluster", F.posexplode("v").alias("n", "x"))
    return d.select("cluster", F.col("n").cast("long").alias("n"), r6("x").alias("x"))


@query(f"WITH {MEANS} SELECT cluster, arg_min(id, (list_distance(v, c), id)) AS id FROM vec JOIN lab USING (id) JOIN cen USING (cluster) GROUP BY cluster")
def representatives(spark, sf):
    return cluster.representatives(vectors(spark, sf), labels(spark, sf))


@query(f"WITH {VEC}, c AS (SELECT id::INT AS cluster, v AS c FROM vec WHERE id < 5) SELECT id, arg_min(cluster, (list_distance(v, c), cluster)) AS cluster FROM vec, c GROUP BY id")
def nearest_centre(spark, sf):
    """One assignment step, the first five vectors being the centres."""
    v = vectors(spark, sf)
    return cluster.assign(v, v.where("id < 5").select(F.col("id").cast("int").alias("cluster"), "v"))
