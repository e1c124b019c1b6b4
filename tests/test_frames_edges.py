"""Frames, angles and labels with nulls, odd sizes and other edges of their domain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.operators import fourier, knn as nn, stats, trajectory as tr


def test_contacts_keep_the_place_of_a_missing_atom(spark):
    atoms = [[0.0, 0.0, 0.0], None, [0.1, 0.0, 0.0], [0.0, None, 0.0], [0.0, 0.0], [float("nan"), 0.0, 0.0]]
    df = spark.createDataFrame([(0, atoms), (1, []), (2, [None])], "frame long, coords array<array<double>>")
    got = {r.frame: r.idx for r in tr.contacts(df, epsilon=5.0).collect()}
    assert got == {0: [0, 2, 12, 14], 1: [], 2: []}
    assert tr.contacts(df.where("frame = 0"), 5.0, [1, 2], [0, 1, 2]).first().idx == [3, 5]


def brute_pairs(x, y, reach):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    return np.flatnonzero((d < reach).ravel())


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e9])
def test_grid_equals_all_pairs(scale):
    rng = np.random.default_rng(int(scale) % 97)
    x, y = rng.standard_normal((300, 3)) * scale, rng.standard_normal((200, 3)) * scale
    x[7] = np.nan
    y[:20] = x[10:30]
    assert np.array_equal(tr.near_pairs(x, y, 1.0), brute_pairs(x, y, 1.0))
    assert len(tr.near_pairs(x, y, 0.0)) == 0


def test_a_large_structure(spark):
    x = np.random.default_rng(4).random((100_000, 3)) * 20
    got = tr.near_pairs(x, x, 0.5)
    some = np.random.default_rng(5).choice(100_000, 50, replace=False)
    for i in some:
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(axis=1)) < 0.5)
        a, b = np.searchsorted(got, [i * 100_000, (i + 1) * 100_000])
        assert np.array_equal(got[a:b] - i * 100_000, near)
    rows = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x[:5000])], "frame long, atom long, x double, y double, z double")
    pairs = {(r.a, r.b) for r in tr.contact_pairs(rows, 0.5, 1.0).collect()}
    assert pairs == {divmod(int(k), 5000) for k in tr.near_pairs(x[:5000], x[:5000], 0.5)}


def test_contact_pairs_leave_out_unsound_atoms(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0), (0, 1, None, 0.0, 0.0), (0, 2, float("nan"), 0.0, 0.0), (0, 3, 0.4, 0.0, 0.0), (1, 4, 0.0, 0.0, 0.0)]
    got = tr.contact_pairs(spark.createDataFrame(rows, "frame long, atom long, x double, y double, z double"), 5.0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0), (0, 0, 3), (0, 3, 0), (0, 3, 3), (1, 4, 4)]


def test_rmsd_of_another_size_is_null(spark):
    ref = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    rows = [(0, 0.0, ref), (1, 0.0, [[0.0, 0.0, 0.0]]), (2, 0.0, ref + ref), (3, 0.0, [[0.0, 0.0, 0.0], None]), (4, 0.0, None), (5, 0.0, [[0.0, 0.0, 0.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, "frame long, time double, coords array<array<double>>")
    got = {r.frame: r.rmsd for r in tr.rmsd_to(df, ref).collect()}
    assert got == {0: pytest.approx(0), 1: None, 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(ValueError):
        tr.rmsd_to(df, [])


def test_joint_pdf_leaves_null_labels_out(spark):
    labels = spark.createDataFrame([(i, None if i % 2 else i % 4) for i in range(12)], "id long, cluster int")
    own = spark.createDataFrame([(i, None if i == 0 else i % 3) for i in range(12)], "id long, replicate int")
    got = stats.joint_pdf(labels, own).collect()
    assert sum(r.p for r in got) == pytest.approx(1) and all(r.cluster is not None and r.replicate is not None for r in got)


def test_rekey_of_strings_and_odd_names(spark):
    df = spark.createDataFrame([("b", 1, 2, 3), (None, 4, 5, 6), ("a", 7, 8, 9), ("b", 0, 0, 0)], "k string, _part long, _base long, at long")
    got = tr.rekey(df, "k", "n")
    assert got.columns == ["k", "_part", "_base", "at", "n"]
    rows = sorted(got.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == [0, 1, 2, 3] and [r.k for r in rows] == [None, "a", "b", "b"] and [r["_part"] for r in rows] == [4, 7, 1, 0]
    assert tr.rekey(df.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 12, 50])
@pytest.mark.parametrize("longest", [1_000_000, 3])
def test_fourier_equals_numpy(spark, monkeypatch, n, longest):
    monkeypatch.setattr(fourier, "LONGEST_LINE", longest)
    x = np.random.default_rng(n).standard_normal((2, n, 2)) @ [1, 1j]
    df = spark.createDataFrame([(s, i, float(v.real), float(v.imag)) for s in range(2) for i, v in enumerate(x[s])], fourier.SERIES)
    got = np.zeros((2, n), dtype=complex)
    z = fourier.transform(df, n)
    for r in z.collect():
        got[r.series, r.n] = r.re + 1j * r.im
    assert np.allclose(got, np.fft.fft(x), atol=1e-9)
    for r in fourier.inverse(z, n).collect():
        got[r.series, r.n] = r.re + 1j * r.im
    assert np.allclose(got, x, atol=1e-9)


def smoothed(v, percent, mode):
    """The filter of one table of angles as a plain program does it; bins are counted from 1."""
    z = np.fft.fft(np.exp(1j * v), axis=0)
    n = len(z)
    if mode == "frequency":
        low = round(n * (1 - percent / 100) / 2)
        keep = [b for b in range(1, n + 1) if b <= low or b >= n - low + 1 or b == 1]
        drop = np.ones(n, dtype=bool)
        drop[np.array(keep) - 1] = False
        z[drop] = 0
    else:
        low = np.abs(z) < percent / 100 * np.abs(z[1:]).max()
        low[0] = False
        z[low] = 0
    return np.mod(np.angle(np.fft.ifft(z, axis=0)), 2 * np.pi)


@pytest.mark.parametrize("n,percent", [(10, 50.0), (30, 10.0), (31, 80.0)])
@pytest.mark.parametrize("mode", ["frequency", "amplitude"])
def test_smoothing_equals_a_plain_filter(spark, n, percent, mode):
    v = np.random.default_rng(n).random((n, 2)) * 6
    df = spark.createDataFrame([(3 * i, row.tolist()) for i, row in enumerate(v)], "frame long, v array<double>")
    got = np.array([r.v for r in tr.smooth_angles(df, percent, mode).orderBy("frame").collect()])
    assert np.allclose(np.exp(1j * got), np.exp(1j * smoothed(v, percent, mode)), atol=1e-9) and (got >= 0).all()


def test_a_null_angle_stays_in_its_frame(spark):
    rows = [(i, [0.3, 1.0]) for i in range(12)] + [(12, [None, 1.0]), (13, None)]
    got = {r.frame: r.v for r in tr.smooth_angles(spark.createDataFrame(rows, "frame long, v array<double>"), 50.0, "frequency").collect()}
    assert got[13] is None and all(len(v) == 2 and None not in v for v in got.values() if v)
    assert all(abs(got[f][0] - 0.3) < 0.5 for f in range(12))
    with pytest.raises(ValueError):
        tr.smooth_angles(spark.createDataFrame(rows, "frame long, v array<double>"), mode="other")
    assert tr.smooth_angles(spark.createDataFrame([], "frame long, v array<double>")).count() == 0


def test_knn_refuses_what_it_cannot_answer(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(ValueError, match="k must"):
        nn.knn(df, 0)
    with pytest.raises(ValueError, match="unlike"):
        nn.knn(df, 1)
