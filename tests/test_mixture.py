"""Mixture families and exchange k-means against plain versions."""

import numpy as np
import pytest

from isoflow.operators import mixture as mx


def df_of(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)


def plain(x, labels, k, family, rounds=200, tolerance=1e-7):
    """Expectation maximisation on one array; returns the log likelihood."""
    ridge, eye, r, last = None, np.eye(x.shape[1]), np.eye(k)[labels], -np.inf
    for _ in range(rounds):
        n = r.sum(axis=0)
        mean = (r.T @ x) / n[:, None]
        s = np.array([(r[:, c, None] * (x - mean[c])).T @ (x - mean[c]) / n[c] for c in range(k)])
        if ridge is None:
            ridge = mx.RIDGE * np.trace((n[:, None, None] * s).sum(axis=0)) / x.size
        cov = {
            "full": s,
            "diagonal": s * eye,
            "spherical": np.array([np.trace(m) / x.shape[1] * eye for m in s]),
            "tied": np.array([(n[:, None, None] * s).sum(axis=0) / len(x)] * k),
        }[family] + ridge * eye
        logs = np.stack([np.log(n[c] / len(x)) - 0.5 * np.einsum("ni,ij,nj->n", x - mean[c], np.linalg.inv(cov[c]), x - mean[c]) - 0.5 * np.linalg.slogdet(2 * np.pi * cov[c])[1] for c in range(k)], axis=1)
        total = np.log(np.exp(logs).sum(axis=1))
        r = np.exp(logs - total[:, None])
        if total.sum() - last <= tolerance * abs(total.sum()):
            break
        last = total.sum()
    return total.sum(), r


@pytest.mark.parametrize("shape", mx.FAMILIES)
def test_families_equal_a_plain_version_and_the_right_one_wins(spark, shape):
    rng = np.random.default_rng(4)
    one = np.array([[2.0, 1.2], [1.2, 1.0]])
    cov = {"spherical": [np.eye(2) * 0.2, np.eye(2) * 1.5], "diagonal": [np.diag([3.0, 0.1]), np.diag([0.1, 2.0])], "tied": [one, one], "full": [one, np.array([[1.0, -0.9], [-0.9, 1.5]])]}[shape]
    x = np.concatenate([rng.multivariate_normal(c, m, 220) for c, m in zip(([0, 0], [7, 3]), cov)])
    out, family, bic = mx.mixture(df_of(spark, x), 2)
    assert family == shape
    got = {r.id: (r.cluster, r.uncertainty) for r in out.collect()}
    start = (np.arange(440) >= 220).astype(int)
    for f in mx.FAMILIES:
        top, r = plain(x, start, 2, f)
        assert bic[f] == pytest.approx(2 * top - mx.parameters(f, 2, 2) * np.log(440), rel=1e-5)
        if f == shape:
            assert sum(got[i][0] == r[i].argmax() + 1 for i in range(440)) >= 438
            assert all(got[i][1] == pytest.approx(1 - r[i].max(), abs=0.02) for i in range(440))


def test_no_points(spark):
    out, family, bic = mx.mixture(spark.createDataFrame([], "id long, v array<double>"), 2)
    assert out.count() == 0 and family == "" and bic == {}


def cost(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels.tolist()))


def test_exchange_ends_where_no_move_gains(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((40, 2)), rng.standard_normal((15, 2)) + 3, [[1.5, 1.5]] * 3])
    labels = rng.integers(1, 4, len(x))
    df = df_of(spark, x)
    got = {r.id: r.cluster for r in mx.exchange(df, spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cluster int"), 60).collect()}
    end = np.array([got[i] for i in range(len(x))])
    assert cost(x, end) < cost(x, labels) and set(end.tolist()) == {1, 2, 3}
    for i in range(len(x)):
        for c in (1, 2, 3):
            if c != end[i] and (end == end[i]).sum() > 1:
                other = end.copy()
                other[i] = c
                assert cost(x, other) >= cost(x, end) - 1e-9
    best = {r.id: r.cluster for r in mx.exchange_kmeans(df, 3, starts=3).collect()}
    assert cost(x, np.array([best[i] for i in range(len(x))])) <= cost(x, end) + 1e-6


def test_one_cluster_stays(spark):
    df = df_of(spark, np.arange(6.0).reshape(3, 2))
    assert {r.cluster for r in mx.exchange(df, spark.createDataFrame([(i, 7) for i in range(3)], "id long, cluster int")).collect()} == {7}
