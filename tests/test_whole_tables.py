"""Queries without SQL read their whole table."""

from isoflow.plans.registry import QUERIES


def test_fitted_rmsd_takes_all_frames(spark, tmp_path):
    rows = [(i, [float((7 * i * k + k * k) % 11) for k in range(64)]) for i in range(15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["knn_rmsd_fitted"](spark, str(tmp_path)).collect()
    assert {r.src for r in got} == set(range(15)) and len(got) == 150
