"""Round trips of binary and text files over several partitions."""

import numpy as np
import pytest

from isoflow.sources import lines, matrices


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    for name, value in (("PART_BYTES", 240), ("BATCH", 17), ("STRIDE", 4)):
        monkeypatch.setattr(matrices, name, value)


def test_sparse_rows_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i * 3, sorted(rng.choice(1000, n, replace=False).tolist()), rng.standard_normal(n).tolist()) for i, n in enumerate([0, 3, 40, 1, 0, *rng.integers(0, 9, 30)])]
    df = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(4)
    index, data = f"file://{tmp_path}/r.svi", f"file://{tmp_path}/r.svd"
    matrices.write_sparse_rows(df, index, data)
    want = b"".join(np.array([len(i), *i], dtype="<i4").tobytes() for _, i, _ in rows)
    assert (tmp_path / "r.svi").read_bytes() == want and (tmp_path / "r.svd").read_bytes() == np.array([x for r in rows for x in r[2]]).tobytes()
    back = matrices.read_sparse_rows(spark, index, data)
    assert back.rdd.getNumPartitions() > 2
    assert [(r.idx, r.val) for r in back.orderBy("id").collect()] == [(r[1], r[2]) for r in rows] and sorted(p.name for p in tmp_path.iterdir()) == ["r.svd", "r.svi"]


def test_column_matrix_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    entries = sorted({(int(c), int(r)) for c, r in zip(rng.choice([0, 1, 5, 6, 7, 20, 21], 80), rng.integers(0, 40, 80))} | {(5, r) for r in range(60)})
    rows = [(c, r, float(rng.standard_normal())) for c, r in entries]
    path = f"file://{tmp_path}/m.csc"
    matrices.write_column_matrix(spark.createDataFrame(rows, "col long, row long, w double").repartition(3), path, 24)
    bounds = np.searchsorted([c for c, _, _ in rows], np.arange(25))
    want = np.int32(24).tobytes() + bounds.astype("<i4").tobytes() + np.array([r for _, r, _ in rows], dtype="<i4").tobytes() + np.array([w for *_, w in rows]).tobytes()
    assert (tmp_path / "m.csc").read_bytes() == want
    back = matrices.read_column_matrix(spark, path)
    assert back.rdd.getNumPartitions() > 1 and sorted(tuple(r) for r in back.collect()) == rows
    own = {(r.i, r.j): r.d for r in matrices.symmetric_edges(back.where("col < row")).collect()}
    assert own == {(c, r): w for c, r, w in rows if c < r}
    assert {(r["query"], r["ref"]) for r in matrices.outside_edges(back).collect()} == set(entries)
    with pytest.raises(ValueError):
        matrices.write_column_matrix(spark.createDataFrame([(24, 0, 1.0)], "col long, row long, w double"), f"file://{tmp_path}/x", 24)
    matrices.write_column_matrix(spark.createDataFrame([], "col long, row long, w double"), f"file://{tmp_path}/none", 3)
    assert matrices.read_column_matrix(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 23])
def test_triangle_round_trip(spark, tmp_path, n):
    d = np.random.default_rng(n).random((n, n))
    rows = [(i, j, None if (i + j) % 7 == 6 else float(d[i, j])) for i in range(n) for j in range(i, n)]
    matrices.write_triangle(spark.createDataFrame(rows, "i long, j long, d double").repartition(3), f"file://{tmp_path}/t", n)
    top = float(np.finfo(np.float64).max)
    assert (tmp_path / "t").read_bytes() == np.array([top if x is None else x for *_, x in rows]).tobytes()
    assert sorted(tuple(r) for r in matrices.read_triangle(spark, f"file://{tmp_path}/t").collect()) == rows
    (tmp_path / "bad").write_bytes(b"\0" * 16)
    with pytest.raises(Exception, match="packed triangle"):
        matrices.read_triangle(spark, f"file://{tmp_path}/bad").count()


def test_rows_of_a_triangle():
    for n in (1, 2, 5, 40, 3000):
        at = np.arange(n * (n + 1) // 2)
        assert np.array_equal(matrices.triangle_rows(at, n), np.repeat(np.arange(n), np.arange(n, 0, -1)))


def test_flat_vectors_in_single_precision(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((50, 6))
    df = spark.createDataFrame([(10 - i if i < 5 else i * 7, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>").repartition(4)
    matrices.write_vectors(df, f"file://{tmp_path}/f", 6, "<f4")
    order = np.argsort([10 - i if i < 5 else i * 7 for i in range(50)])
    assert (tmp_path / "f").read_bytes() == x[order].astype("<f4").tobytes()
    with pytest.raises(Exception, match="numbers"):
        matrices.write_vectors(df, f"file://{tmp_path}/g", 5)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]  # nothing of the failed one is left
    with pytest.raises(ValueError, match="shared disk"):
        matrices.write_vectors(df, "s3://bucket/x", 6)


@pytest.mark.parametrize("part,read", [(32 << 20, 4 << 20), (7, 3), (1, 64), (50, 5)])
def test_lines_are_numbered_by_range(spark, tmp_path, monkeypatch, part, read):
    monkeypatch.setattr(lines, "PART_BYTES", part)
    monkeypatch.setattr(lines, "READ_BYTES", read)
    for text in ("a\nbb\n\nccc ddd\n", "a\r\nb", "", "\n\n", "one very long line that goes over ranges\nx", "é\nü"):
        (tmp_path / "t").write_bytes(text.encode())
        got = sorted(tuple(r) for r in lines.numbered_lines(spark, f"{tmp_path}/t").collect())
        want = text.replace("\r\n", "\n").split("\n")
        assert got == list(enumerate(want[:-1] if want[-1] == "" else want)), text


def test_numbers_groups_and_structures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "PART_BYTES", 40)
    (tmp_path / "m").write_text("1 2 3\n\n  4 5e1   -6\n" * 9)
    assert [r.v for r in lines.read_matrix(spark, f"{tmp_path}/m").orderBy("id").collect()] == [[1, 2, 3], [4, 50, -6]] * 9
    got = lines.read_numbers(spark, f"{tmp_path}/m").orderBy("id").collect()
    assert [r.id for r in got] == list(range(54)) and [r.value for r in got] == [1, 2, 3, 4, 50, -6] * 9
    (tmp_path / "g").write_text("7 8\n[ System ]\n" + "\n".join(" ".join(str(x) for x in range(a, a + 5)) for a in range(1, 60, 5)) + "\n[ none ]\n[Two]\n3 1\n[ System ]\n99\n")
    groups: dict = {}
    for r in lines.group_members(spark, f"{tmp_path}/g").orderBy("group", "place").collect():
        groups.setdefault(r["group"], []).append(r.atom)
    assert groups == {"System": [*range(60), 98], "Two": [2, 0]}
    atom = "    1ALA{:>5}{:5d}{:8.3f}{:8.3f}{:8.3f}\n"
    frame = "title\n    3\n" + "".join(atom.format(n, i, i, -0.5, 1.25) for i, n in enumerate(("N", "CA", "1HB"), 1)) + "   1.0 1.0 1.0\n"
    (tmp_path / "s.gro").write_text(frame * 3)
    got = lines.read_gro(spark, f"{tmp_path}/s.gro").orderBy("frame", "serial").collect()
    assert len(got) == 9 and tuple(got[4]) == (1, 2, "CA", "ALA", 1, 2.0, -0.5, 1.25, 12.011) and [r.mass for r in got[:3]] == [14.007, 12.011, 1.008]
