"""Ways of larger tables, against the ways of small ones: spans for eigenpairs, references read from files, paths and scaling by tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.operators import blocks, graph as g, knn as nn, krylov, paths, sparse_index, spectral


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, v array<double>")


def affinity(spark, x, k=7):
    own = g.symmetric_graph(nn.knn(vectors(spark, x), k))
    return g.normalised(g.local_affinity(own, g.local_sigma(own, 3))).persist()


def test_spans_give_the_pairs_of_lapack(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = affinity(spark, np.concatenate([rng.standard_normal((150, 3)), rng.standard_normal((40, 3)) + 50]))
    want = [df.orderBy(*df.columns[: len(df.columns) - 2]).collect() for df in spectral.top_eigs(a, 4)]
    monkeypatch.setattr(spectral, "DRIVER_NODES", 20)
    # Neither LAPACK nor blocks.
    monkeypatch.setattr(spectral, "block_eigs", None)
    values, vecs = spectral.top_eigs(a, 4)
    assert [r.eigenvalue for r in values.orderBy("k").collect()] == pytest.approx([r.eigenvalue for r in want[0]], abs=1e-12)
    assert want[0][1].eigenvalue == pytest.approx(1, abs=1e-12)  # two parts: 1 is there twice
    assert all(r.converged and r.residual < 1e-10 for r in values.collect())
    got = {(r.id, r.k): r.value for r in vecs.collect()}
    assert len(got) == 4 * 190 and all(abs(got[r.id, r.k] - r.value) < 1e-8 for r in want[1] if r.k > 2)


def test_spans_of_few_directions_and_of_all():
    p = np.random.default_rng(4).standard_normal((90, 5))
    m = p @ p.T
    for size in (90, 6):
        want = np.linalg.eigvalsh(m[:size, :size])[::-1][:6]
        values, v, _ = krylov.largest(lambda x, m=m[:size, :size]: m @ x, size, 6, 1e-12, relative=False)
        assert np.allclose(values, want, atol=1e-9) and np.allclose(v.T @ v, np.eye(6), atol=1e-10)
    with pytest.raises(RuntimeError):
        krylov.largest(lambda x: np.sort(np.random.default_rng(1).random(3000))[:, None] * x, 3000, 4, 1e-8, restarts=1)


def test_rounds_do_not_stay_on_disk(spark):
    a = affinity(spark, np.random.default_rng(5).standard_normal((120, 3)))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    values, vecs = spectral.block_eigs(a, 2, aim=1e-12)
    assert values.count() == 2 and vecs.count() == 240
    # Edges, nodes, tiles, blocks, vectors and three rounds; there were over ten rounds.
    assert len(set(os.listdir(folder)) - before) <= 8


@pytest.mark.parametrize("k", [4, None])
def test_references_are_read_from_files(spark, monkeypatch, k):
    x = np.random.default_rng(6).standard_normal((90, 5))
    sparse = vectors(spark, x).select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i).alias("idx"), F.col("v").alias("val"))
    calls = [lambda: nn.knn(vectors(spark, x), k), lambda: nn.knn_sparse(sparse, k), lambda: nn.knn(vectors(spark, x), k, vectors(spark, x[:7] + 0.1), exclude="none")]

    def rows(call):
        return sorted((r.src, r.dst, r["rank"] or 0, round(r.dist, 9)) for r in call().collect())

    want = [rows(c) for c in calls]
    monkeypatch.setattr(nn, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(nn, "NEAR_ROWS", 16)
    # A store that only Spark reads.
    with monkeypatch.context() as m:
        m.setattr(nn, "files_of", lambda df: None)
        assert [rows(c) for c in calls] == want
    monkeypatch.setattr(nn, "sent", None)
    monkeypatch.setattr(nn, "shuffled_sides", None)
    assert [rows(c) for c in calls] == want


def test_paths_by_tasks_equal_those_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.random(60) * 5) if a < b]
    df = spark.createDataFrame(edges + [(40, 41, 0.5), (0, 29, 0.0), (50, 60, None)], "i long, j long, d double")
    some = spark.createDataFrame([(40,), (3,), (999,)], "id long")

    def rows():
        return [sorted((r.i, r.j, None if r.d is None else round(r.d, 9)) for r in x.collect()) for x in (paths.all_pairs(df), paths.all_pairs(df, some))]

    monkeypatch.setattr(paths, "ROW", 7)
    got = rows()
    monkeypatch.setattr(paths, "TASK_EDGES", 0)
    assert got == rows()


def test_scaling_of_more_points_than_the_driver_takes(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((60, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    pairs = spark.createDataFrame([(3 * i, 3 * j, float(d[i, j])) for i in range(60) for j in range(i, 60)], "i long, j long, d double")
    want = [sorted(map(tuple, df.collect())) for df in spectral.classical_scaling(pairs, 3)]
    monkeypatch.setattr(spectral, "LANDMARKS", 20)
    monkeypatch.setattr(paths, "ROW", 7)
    got = [sorted(map(tuple, df.collect())) for df in spectral.classical_scaling(pairs, 3)]
    for a, b in zip(got, want):
        assert len(a) == len(b) and np.allclose(a, b, atol=1e-8)
    # More dimensions than the points have.
    assert [r.eigenvalue for r in spectral.classical_scaling(pairs, 5)[0].orderBy("k").collect()][3:] == pytest.approx([0, 0], abs=1e-9)
    with pytest.raises(ValueError, match="every pair"):
        spectral.classical_scaling(pairs.where("i <> 3 OR j <> 30"), 3)
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 12))
    values = spectral.geodesic_scaling(own, 2)[0].orderBy("k").collect()
    monkeypatch.setattr(spectral, "LANDMARKS", 2048)
    assert [r.eigenvalue for r in values] == pytest.approx([r.eigenvalue for r in spectral.geodesic_scaling(own, 2)[0].orderBy("k").collect()], abs=1e-7)


def test_an_index_that_names_each_pair_often_is_not_read(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, sorted(rng.choice(12, 6, replace=False).tolist()), rng.random(6).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>")
    want = sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in sparse_index.knn_sparse_indexed(df, 4).collect())
    monkeypatch.setattr(sparse_index, "FEW_MEETINGS", 0)
    monkeypatch.setattr(sparse_index, "candidates", None)
    assert sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in sparse_index.knn_sparse_indexed(df, 4).collect()) == want


def test_pairs_are_centred_where_they_are(spark):
    x = np.random.default_rng(5).standard_normal((20, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(20) for j in range(i, 20)], "i long, j long, d double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spectral.double_centred(pairs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.i, r.j): r.b for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    c = x - x.mean(axis=0)
    assert len(got) == 210 and all(b == pytest.approx(c[i] @ c[j], abs=1e-9) for (i, j), b in got.items())
