"""Operators against numpy on small inputs, and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.functions import geometry as geo
from isoflow.operators import cluster, graph as g, knn as nn, paths, spectral, stats, trajectory as tr


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def edge_set(df):
    return {(r.src, r.rank): r.dst for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "correlation"])
def test_knn_is_brute_force(spark, metric):
    x = np.random.default_rng(1).standard_normal((60, 5))
    if metric == "euclidean":
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
    else:
        d = np.sqrt(np.maximum(0, (1 - np.corrcoef(x)) / 2))
    np.fill_diagonal(d, np.inf)
    got = edge_set(nn.knn_join(vectors(spark, x), None, ["v"], nn.euclidean_blocks if metric == "euclidean" else nn.correlation_blocks, 4, "self", rows=16))
    want = {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert got == want


@pytest.mark.parametrize("exclude", ["self", "rank0", "none"])
@pytest.mark.parametrize("metric", ["euclidean", "correlation"])
def test_pivots_spare_blocks_and_lose_nothing(spark, monkeypatch, metric, exclude):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((60, 4)) * 0.05 + rng.standard_normal(4) * 20 for _ in range(12)] + [np.ones((2, 4)), np.zeros((30, 4)) + [5, 1, 0, 0]])
    df = vectors(spark, x)
    want = sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in nn.knn(df, 5, metric=metric, exclude=exclude).collect())
    for name, value in (("BROADCAST_NUMBERS", 0), ("PIVOTS", 40)):
        monkeypatch.setattr(nn, name, value)
    distance = {"euclidean": nn.euclidean_blocks, "correlation": nn.correlation_blocks}[metric]
    sound, need = F.lit(True), 6 if exclude == "rank0" else 5
    got = sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in nn.knn_join(df, None, ["v"], distance, 5, exclude, 16, 32, sound, bounded=True).collect())
    assert got == want
    if metric == "euclidean":
        sides = nn.pivoted(df, df, ["v"], distance, need, exclude != "self", 32, 16)
        n_q, sent = sides.where("kind = 0").count(), sides.where("kind = 1").count()
        n_r = nn.pivoted(df, df, ["v"], distance, need, exclude != "self", 32, 16).where("kind = 1").select("rows").distinct().count()
        assert sent < n_q * n_r / 5


def test_pivots_for_structures(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 5, 3))
    rows = [(i, (base[i % 6] + 0.02 * rng.standard_normal((5, 3))).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, coords array<array<double>>")
    want = sorted((r.src, r["rank"], round(r.dist, 6)) for r in nn.knn_rmsd(df, 4).collect())
    monkeypatch.setattr(nn, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(nn, "PIVOTS", 12)
    assert sorted((r.src, r["rank"], round(r.dist, 6)) for r in nn.knn_rmsd(df, 4).collect()) == want


def test_knn_edges_of_the_domain(spark):
    v = vectors(spark, [[0, 0], [0, 0], [1, 0]])
    got = nn.knn(v, 10).collect()
    assert len(got) == 6 and {r.dist for r in got if r.src < 2 and r.dst < 2} == {0.0}
    assert nn.knn(vectors(spark, np.zeros((0, 2))), 3).count() == 0
    # A constant vector has no correlation with any other.
    assert nn.knn(vectors(spark, [[1, 1, 1], [1, 2, 3], [3, 1, 2]]), 2, metric="correlation").where("src = 0 OR dst = 0").count() == 0
    with pytest.raises(ValueError):
        nn.knn(v, 1, exclude="all")


def test_sparse_knn_keeps_pairs_without_common_features(spark):
    s = spark.createDataFrame([(0, [0], [3.0]), (1, [1], [4.0]), (2, [0, 1], [3.0, 4.0])], "id long, idx array<int>, val array<double>")
    d = {(r.src, r.dst): r.dist for r in nn.knn_sparse(s, 5).collect()}
    assert d[0, 1] == pytest.approx(5) and d[0, 2] == pytest.approx(4) and d[1, 2] == pytest.approx(3)


def test_rmsd_ignores_rigid_motion(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((7, 3))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [(0, x.tolist()), (1, (x @ q + [5, -3, 1]).tolist()), (2, rng.standard_normal((7, 3)).tolist())]
    df = spark.createDataFrame(rows, "id long, coords array<array<double>>")
    d = {(r.src, r.dst): r.dist for r in nn.knn_rmsd(df, 2).collect()}
    assert d[0, 1] == pytest.approx(0, abs=1e-5) and d[0, 2] > 1
    f = df.select(F.col("id").alias("frame"), F.lit(0.0).alias("time"), "coords")
    assert tr.rmsd_to(f, x.tolist()).where("frame = 1").first().rmsd == pytest.approx(0, abs=1e-5)


def test_symmetric_graph_prefers_the_larger_end(spark):
    e = spark.createDataFrame([(0, 1, 1, 5.0), (1, 0, 1, 7.0), (2, 2, 1, 0.0), (2, 0, 2, 3.0)], "src long, dst long, rank long, dist double")
    assert {(r.i, r.j, r.d) for r in g.symmetric_graph(e).collect()} == {(0, 1, 7.0), (0, 2, 3.0)}
    got = {(r["query"], r.ref, r.w) for r in g.directed_graph(e, symmetric=True).collect()}
    assert got == {(0, 1, 5.0), (1, 0, 7.0), (2, 2, 0.0), (2, 0, 3.0), (0, 2, 3.0)}


def test_entropic_bandwidth_has_the_perplexity(spark):
    d2 = np.random.default_rng(3).random(20)
    sigma = g.solve_bandwidth(d2, 7.0)
    p = np.exp(-d2 / (2 * sigma**2))
    p /= p.sum()
    assert np.exp(-(p * np.log(p)).sum()) == pytest.approx(7.0, abs=1e-6)
    assert np.isnan(g.solve_bandwidth(np.zeros(5), 3.0))


def test_helix_angles(spark):
    t = np.arange(12)
    helix = np.stack([np.cos(1.7 * t), np.sin(1.7 * t), 0.4 * t], axis=1).tolist()
    line = [[float(i), 0.0, 0.0] for i in range(12)]
    df = spark.createDataFrame([(0, helix), (1, line)], "frame long, coords array<array<double>>")
    got = {r.frame: r.a for r in df.select("frame", geo.alpha_angles(F.col("coords")).alias("a")).collect()}
    assert len(got[0]) == 2 * 12 - 5
    assert np.ptp(got[0][:10]) == pytest.approx(0, abs=1e-9) and np.ptp(got[0][10:]) == pytest.approx(0, abs=1e-9)
    assert max(got[1][:10]) == pytest.approx(0) and set(got[1][10:]) == {None}


def test_subspace_iteration_agrees_with_lapack(spark):
    x = np.random.default_rng(4).standard_normal((80, 3))
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 6))
    a = g.normalised(g.local_affinity(own, g.local_sigma(own, 3))).persist()
    dense = [r.eigenvalue for r in spectral.top_eigs(a, 2)[0].orderBy("k").collect()]
    nodes = a.select(F.col("i").alias("id")).union(a.select("j")).distinct()
    values, vecs = spectral.subspace_eigs(a, nodes, 2, 25, 1, tolerance=1e-4)
    got = [r.eigenvalue for r in values.orderBy("k").collect()]
    assert dense[0] == pytest.approx(1, abs=1e-9) and got == pytest.approx(dense, abs=5e-3)


def test_scaling_recovers_distances(spark):
    x = np.random.default_rng(5).standard_normal((15, 2))
    d = spark.createDataFrame([(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(15) for j in range(i, 15)], "i long, j long, d double")
    _, c = spectral.classical_scaling(d, 2)
    y = np.zeros((15, 2))
    for r in c.collect():
        y[r.id, r.k - 1] = r.value
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2), atol=1e-8)


def test_shortest_paths(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 2.0)], "i long, j long, d double")
    got = {(r.i, r.j): r.d for r in paths.all_pairs(e).collect()}
    assert got[0, 2] == 2 and got[0, 3] is None and got[3, 4] == 2 and got[1, 1] == 0
    hops = {(r.i, r.j): r.d for r in paths.hop_paths(e, spark.createDataFrame([(0,)], "id long"), 1).collect()}
    assert hops == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 5.0}


def test_mutual_information_of_equal_and_independent_labels(spark):
    same = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, cluster int")
    own = same.withColumnRenamed("cluster", "replicate")
    assert stats.mutual_information(stats.joint_pdf(same, own)).first().nmi == pytest.approx(1)
    other = spark.createDataFrame([(i, i // 3 % 2) for i in range(30)], "id long, replicate int")
    assert stats.mutual_information(stats.joint_pdf(same, other)).first().nmi == pytest.approx(0, abs=1e-9)


def test_rings_are_two_clusters(spark):
    a = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    x = np.concatenate([np.stack([np.cos(a), np.sin(a)], 1), 4 * np.stack([np.cos(a), np.sin(a)], 1)])
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 6)).persist()
    _, vecs = spectral.decompose(own, 2, k_sigma=3)
    got = {r.id: r.cluster for r in cluster.kmeans(cluster.coordinates(vecs, 2), 2, starts=3).collect()}
    assert {got[i] for i in range(60)} == {1} and {got[i] for i in range(60, 120)} == {2}


def test_frames(spark):
    rows = [(i, i * 0.5, 1000.0, [[float(i), 0.0, 0.0], [float(i) + 0.5, 0.0, 0.0]]) for i in range(10)]
    f = spark.createDataFrame(rows, "frame long, time double, prec double, coords array<array<double>>")
    s = tr.summary(f).first()
    assert (s.n_frames, s.n_atoms, s.start_time, s.end_time) == (10, 2, 0.0, 4.5)
    a, b = tr.split(f, 3)
    assert [r.frame for r in tr.rekey(a).orderBy("frame").collect()] == [0, 1, 2, 3] and b.count() == 6
    # Strictly below the cutoff: 0.5 nm are 5 Angstrom.
    assert tr.contacts(f, 5.0).first().idx == [0, 3] and tr.contacts(f, 5.1).first().idx == [0, 1, 2, 3]
    assert tr.sample(f, 4, "frame").collect() == tr.sample(f, 4, "frame").collect()


def test_smoothing_keeps_a_pure_wave(spark):
    v = np.mod(2 * np.pi * np.arange(32) / 32 * 3, 2 * np.pi)
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(v)], "frame long, v array<double>")
    got = np.array([r.v[0] for r in tr.smooth_angles(df).orderBy("frame").collect()])
    assert np.allclose(np.exp(1j * got), np.exp(1j * v), atol=1e-9)


@pytest.mark.parametrize("numbers", [0, nn.BROADCAST_NUMBERS])
def test_unsound_rows_and_repeated_ids(spark, monkeypatch, numbers):
    monkeypatch.setattr(nn, "BROADCAST_NUMBERS", numbers)
    rng = np.random.default_rng(1)
    rows = [(i, rng.random(2).tolist()) for i in range(40)] + [(3, [0.5, 0.1]), (None, [1.0, 1.0]), (100, None), (101, []), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    good = [(i, np.array(v)) for i, v in rows[:41]]
    got = nn.knn(df, 3).collect()
    want = []
    for i, v in good:
        near = sorted((np.linalg.norm(v - w), j) for j, w in good if j != i)[:3]
        want += [(i, j, r + 1, round(float(d), 6)) for r, (d, j) in enumerate(near)]
    assert sorted((r.src, r.dst, r["rank"], round(r.dist, 6)) for r in got) == sorted(want)
    assert nn.knn(df.where("id > 99"), 3).count() == 0 and nn.knn(df.limit(0), 3).count() == 0
    assert nn.knn(df, None, exclude="none").count() == 41 * 41


def test_rekey_and_windows(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "c"), (9, "d")], "frame long, x string")
    assert [r.frame for r in tr.rekey(df.select("frame", "x")).orderBy("frame").collect()] == [0, 1, 2, 3]
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(i, i + r, r, float(d)) for i in range(50) for r, d in enumerate(np.sort(rng.random(4)) + 1, 1)], "src long, dst long, rank long, dist double")
    want = {r.id: r.est for r in stats.windowed_dimension(edges, [2, 3, 4], 5).collect()}
    assert sorted(want) == list(range(4, 50))
    monkeypatch.setattr(stats, "WINDOW_ROWS", 7)
    got = {r.id: r.est for r in stats.windowed_dimension(edges, [2, 3, 4], 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_short_chains_null_frames_and_groups(spark):
    rows = [(0, [[0.0, 0.0, 0.0], [0.1, 0.0, 0.0]]), (1, None), (2, [[0.0, 0.0, 0.0], [0.1, 0.0, 0.0], [0.5, 0.5, 0.0], [2.0, 0.0, 0.0]])]
    df = spark.createDataFrame(rows, "frame long, coords array<array<double>>")
    assert [len(r.a) for r in df.where("frame <> 1").orderBy("frame").select(geo.alpha_angles(F.col("coords")).alias("a")).collect()] == [0, 3]
    assert [len(r.a) for r in df.where("frame <> 1").orderBy("frame").select(geo.backbone_torsions(F.col("coords")).alias("a")).collect()] == [0, 1]
    got = {r.frame: r.idx for r in tr.contacts(df, epsilon=9.0).collect()}
    assert got == {0: [0, 1, 2, 3], 1: None, 2: [0, 1, 2, 4, 5, 6, 8, 9, 10, 15]}
    assert {r.frame: r.idx for r in tr.contacts(df, 9.0, [0, 1], [1]).collect()} == {0: [0, 1], 1: None, 2: [0, 1]}
    timed = df.withColumn("time", F.lit(0.0)).where("frame < 2")
    assert [(r.frame, r.rmsd) for r in tr.rmsd_to(timed, rows[0][1]).orderBy("frame").collect()] == [(0, 0.0), (1, None)]


def test_empty_tables(spark):
    points = spark.createDataFrame([], "id long, v array<double>")
    assert cluster.kmeans(points, 2).count() == 0 and cluster.gaussian_mixture(points, 2).count() == 0
    edges = spark.createDataFrame([], "i long, j long, w double")
    assert [x.count() for x in spectral.top_eigs(edges, 2)] == [0, 0]
    graph = edges.withColumnRenamed("w", "d")
    assert [x.count() for x in spectral.classical_scaling(graph)] == [0, 0] and spectral.bisect(spark, graph).count() == 0


def test_block_method_gives_the_vectors(spark):
    x = np.random.default_rng(8).standard_normal((30, 2))
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 6))
    a = g.normalised(g.local_affinity(own, g.local_sigma(own, 3))).persist()
    _, dense = spectral.top_eigs(a, 2)
    nodes = a.select(F.col("i").alias("id")).union(a.select("j")).distinct()
    values, vecs = spectral.subspace_eigs(a, nodes, 2, 60, 1)
    assert all(r.converged for r in values.collect())
    want, got = ({(r.id, r.k): r.value for r in d.collect()} for d in (dense, vecs))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    with pytest.raises(RuntimeError):
        spectral.subspace_eigs(a, nodes, 2, 1, 1)
