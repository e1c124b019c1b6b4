import numpy as np
import pytest

from isoflow.sources import flat


def test_vectors_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flat, "PART_BYTES", 400)
    x = np.random.default_rng(1).standard_normal((100, 7))
    x.tofile(tmp_path / "x.pts")
    got = flat.read_vectors(spark, f"file://{tmp_path}/x.pts", 7).orderBy("id").collect()
    assert [r.id for r in got] == list(range(100)) and np.array_equal(np.array([r.v for r in got]), x)
    with pytest.raises(Exception, match="rows of 8"):
        flat.read_vectors(spark, f"file://{tmp_path}/x.pts", 8).count()


def test_text_formats(spark, tmp_path):
    (tmp_path / "s.dat").write_text("1.5\n2\n\n-3e1\n")
    assert [tuple(r) for r in flat.read_series(spark, f"{tmp_path}/s.dat").collect()] == [(0, 1.5), (1, 2.0), (2, -30.0)]
    (tmp_path / "a.pdb").write_text("MODEL\nATOM      1  CA  ALA A   7      10.000 -20.500   3.250  1.00  0.00\nEND\n")
    assert tuple(flat.read_pdb(spark, f"{tmp_path}/a.pdb").first()) == (1, "CA", "ALA", 7, 1.0, -2.05, 0.325)
    labels = spark.createDataFrame([(i, i % 2 + 1) for i in range(50)], "id long, cluster int")
    flat.group_lines(labels).coalesce(1).write.text(f"{tmp_path}/g")
    back = {r.group: r.atoms for r in flat.read_groups(spark, f"{tmp_path}/g").collect()}
    assert back == {"cluster_1": list(range(0, 50, 2)), "cluster_2": list(range(1, 50, 2))}
