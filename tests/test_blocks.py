"""Eigenpairs by blocks, bisection by levels, landmark scaling and shortest paths, against dense versions."""

import heapq
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.operators import blocks, cluster, graph as g, knn as nn, paths, spectral
from isoflow.plans.registry import ORACLE, QUERIES


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, v array<double>")


def dense_of(edges, n):
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r.i, r.j] = a[r.j, r.i] = r.w
    return a


@pytest.mark.parametrize("rows", [1000, 40])
def test_blocks_give_the_pairs_of_lapack(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "FEW_BLOCKS", rows // 20)
    x = np.random.default_rng(3).standard_normal((150, 3))
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 7))
    a = g.normalised(g.local_affinity(own, g.local_sigma(own, 3))).persist()
    val, vec = np.linalg.eigh(dense_of(a, 150))
    values, vectors_ = spectral.block_eigs(a, 4, rows=rows)
    values = values.orderBy("k").collect()
    assert [r.k for r in values] == [1, 2, 3, 4] and all(r.converged for r in values)
    assert [r.eigenvalue for r in values] == pytest.approx(val[::-1][:4].tolist(), abs=1e-10)
    got = np.zeros((150, 4))
    for r in vectors_.collect():
        got[r.id, r.k - 1] = r.value
    want = spectral.fix_signs(vec[:, ::-1][:, :4])
    assert np.allclose(got, want, atol=1e-6)
    # The residual is that of the vectors returned.
    m = dense_of(a, 150)
    off = np.linalg.norm(m @ got - got * [r.eigenvalue for r in values], axis=0)
    assert np.allclose(off, [r.residual * r.eigenvalue for r in values], atol=1e-9)


def test_sets_are_solved_side_by_side(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for s, n in ((0, 40), (5, 25), (9, 3)):
        m = rng.random((n, n))
        m = m + m.T
        rows += [(s, i, j, float(m[i, j])) for i in range(n) for j in range(i, n)]
        want[s] = np.linalg.eigvalsh(m)[::-1]
    pairs, vecs = blocks.largest_eigs(spark.createDataFrame(rows, "set long, i long, j long, w double"), 2, rows=16)
    assert {(s, k): pytest.approx(float(want[s][k - 1]), abs=1e-7) for s, k in ((s, k) for s in want for k in (1, 2))} == {(s, k): v for s, k, v, _ in pairs}
    norms = vecs.groupBy("set", "k").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert len(norms) == 6 and all(r.n == pytest.approx(1) for r in norms)


@pytest.mark.parametrize("aim", [1e-13, 0.0])
def test_an_aim_gives_exact_vectors_and_may_be_out_of_reach(spark, aim):
    x = np.random.default_rng(3).standard_normal((150, 3))
    a = g.fixed_affinity(g.symmetric_graph(nn.knn(vectors(spark, x), 7)), 0.9).persist()
    want = {r.id: r.degree for r in g.degrees(a).collect()}
    total = sum(want.values())
    values, vecs = spectral.block_eigs(g.normalised(a), 1, aim=aim)
    got = {r.id: r.value for r in vecs.collect()}
    assert values.first().converged and got.keys() == want.keys()
    assert max(abs(got[i] - (d / total) ** 0.5) for i, d in want.items()) < 1e-12


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_first_vector_equals_sql_where_a_value_is_near_a_tie(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = {k: round(v * 1e6) for k, v in con.execute(ORACLE["leading_eigenvector_fixed"]).fetchall()}
    got = {r.id: round(r.value * 1e6) for r in QUERIES["leading_eigenvector_fixed"](spark, sf).collect()}
    assert got == want


def test_rounds_run_out(spark):
    x = np.random.default_rng(8).standard_normal((60, 2))
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 6))
    with pytest.raises(RuntimeError):
        spectral.block_eigs(g.normalised(g.fixed_affinity(own, 1.0)), 3, iterations=2)


def test_copies_without_a_bandwidth_are_left_out(spark):
    x = np.concatenate([np.zeros((6, 2)), np.random.default_rng(2).standard_normal((30, 2)) + 3])
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 4))
    values, vecs = spectral.decompose(own, 2, k_sigma=3)
    assert values.where("k = 1").first().eigenvalue == pytest.approx(1)
    ids = {r.id for r in vecs.collect()}
    assert ids and ids <= set(range(6, 36))


def by_stack(a, relaxation, partition):
    """Bisection of one dense matrix with a stack, as a plain program does it."""

    def solve(at):
        if len(at) < 3:
            return None
        sub = a[np.ix_(at, at)]
        deg = sub.sum(axis=1)
        if (deg <= 0).any():
            return None
        val, vec = np.linalg.eigh(sub / np.sqrt(np.outer(deg, deg)))
        return (np.inf if 1 - val[-2] <= 1e-12 else 1 / (1 - val[-2])), vec[:, [-1, -2]]

    label, settled, stack = np.zeros(len(a), dtype=int), 0, [np.arange(len(a))]
    while stack:
        at = stack.pop()
        whole = solve(at)
        halves = None
        if whole is not None:
            two = cluster.lloyd(whole[1], 2, seed=42)
            parts = [at[two == c] for c in (0, 1)]
            both = [solve(p) for p in parts]
            if all(b is not None for b in both) and not whole[0] < relaxation * (both[0][0] + both[1][0]):
                halves = [b[0] for b in both]
        if halves is None:
            settled += 1
            label[at] = settled
            continue
        slow = 0 if halves[0] >= halves[1] else 1
        if max(halves) > partition * min(halves):
            settled += 1
            label[parts[1 - slow]] = settled
            stack.append(parts[slow])
        else:
            stack += parts
    return label


def parted(label):
    return {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())}


@pytest.mark.parametrize("set_nodes", [2048, 70])
def test_bisection_by_levels_equals_a_stack(spark, monkeypatch, set_nodes):
    monkeypatch.setattr(spectral, "SET_NODES", set_nodes)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((n, 2)) * 0.3 + c for n, c in ((30, (0, 0)), (25, (4, 0)), (20, (0, 5)), (8, (9, 9)))])
    own = g.symmetric_graph(nn.knn(vectors(spark, x), 30)).persist()
    got = {r.id: r.cluster for r in spectral.bisect(spark, own, sigma=1.0).collect()}
    want = by_stack(dense_of(g.fixed_affinity(own, 1.0), len(x)), 1.2, 2.0)
    label = np.array([got[i] for i in range(len(x))])
    assert parted(label) == parted(want) and len(set(want.tolist())) > 1
    if set_nodes == 2048:  # the same vectors, so the same order too
        assert label.tolist() == want.tolist()


def test_lloyd_by_set(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, (rng.standard_normal(2) * 0.1 + (5 * (i % 2), s)).tolist()) for s in (0, 3) for i in range(20)]
    got = {(r["set"], r.id): r.cluster for r in cluster.lloyd_by_set(spark.createDataFrame(rows, "set long, id long, v array<double>"), 2).collect()}
    assert len(got) == 40
    for s in (0, 3):
        assert {got[s, i] for i in range(0, 20, 2)} | {got[s, i] for i in range(1, 20, 2)} == {0, 1} and len({got[s, i] for i in range(0, 20, 2)}) == 1


def test_landmarks_recover_distances(spark):
    x = np.random.default_rng(5).standard_normal((60, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    own = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(8) for j in range(i, 8)], "i long, j long, d double")
    outside = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(8, 60) for j in range(8) if not (i == 59 and j == 2)], "query long, ref long, w double")
    values, c = spectral.landmark_scaling(own, outside, 5)
    assert [r.k for r in values.orderBy("k").collect()] == [1, 2, 3]
    y = np.full((60, 3), np.nan)
    for r in c.collect():
        y[r.id, r.k - 1] = r.value
    assert np.isnan(y[59]).all() and not np.isnan(y[:59]).any()
    assert np.allclose(np.linalg.norm(y[:59, None] - y[None, :59], axis=2), d[:59, :59], atol=1e-8)


def test_scaling_of_parts_is_an_error(spark):
    d = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 1, 0.0), (2, 2, 0.0), (0, 2, None), (1, 2, None)], "i long, j long, d double")
    with pytest.raises(ValueError, match="every pair"):
        spectral.classical_scaling(d)


def dijkstra(edges, source):
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == u and y not in dist:
                    heapq.heappush(heap, (d + w, y))
    return dist


def test_paths_equal_dijkstra(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.random(60) * 5) if a < b]
    edges += [(40 + i, 41 + i, 0.5) for i in range(12)] + [(0, 29, 0.0), (50, 60, None)]  # a long chain apart
    df = spark.createDataFrame(edges, "i long, j long, d double")
    real = [e for e in edges if e[2] is not None]
    nodes = sorted({x for e in edges for x in e[:2]})
    want = {s: dijkstra(real, s) for s in nodes}
    got = {(r.i, r.j): r.d for r in paths.all_pairs(df).collect()}
    assert set(got) == {(i, j) for i in nodes for j in nodes if i <= j}
    assert all(d is None if j not in want[i] else d == pytest.approx(want[i][j]) for (i, j), d in got.items())
    some = {(r.i, r.j): r.d for r in paths.all_pairs(df, spark.createDataFrame([(52,), (0,), (999,), (0,)], "id long")).collect()}
    assert set(some) == {(i, j) for i in (0, 52) for j in nodes} and some[52, 40] == pytest.approx(6.0)
    with pytest.raises(ValueError, match="negative"):
        paths.all_pairs(spark.createDataFrame([(0, 1, -1.0)], "i long, j long, d double"))
