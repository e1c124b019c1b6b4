"""The inverted index against the joins of blocks."""

import numpy as np
import pytest

from isoflow.operators import blocks, knn as nn, sparse_index as si

SCHEMA = "id long, idx array<int>, val array<double>"


def rows(seed, n, features, most=6):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        # A few features that most rows have, many that few have.
        f = sorted({*rng.choice(3, 1).tolist(), *(3 + rng.zipf(1.5, rng.integers(0, most)) % features).tolist()})
        out.append((i, f, rng.integers(1, 5, len(f)).astype(float).tolist()))
    return out


@pytest.mark.parametrize("exclude", ["self", "rank0", "none"])
@pytest.mark.parametrize("k", [1, 4])
def test_index_equals_blocks(spark, exclude, k):
    data = rows(1, 80, 50) + [(200, [], []), (201, [99], [1.0]), (3, [0, 1], [1.0, 1.0]), *[(7, [60 + j], [0.5]) for j in range(6)], (None, [1], [1.0]), (300, [1, 2], [1.0]), (301, None, None), (302, [1], [float("nan")])]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted((r.src, r["rank"], round(r.dist, 9)) for r in nn.knn_sparse(df, k, exclude=exclude).collect())
    got = si.knn_sparse_indexed(df, k, exclude=exclude).collect()
    assert sorted((r.src, r["rank"], round(r.dist, 9)) for r in got) == want


def test_ids_and_ties(spark):
    a, b = rows(2, 30, 20), [(i + 100, f, v) for i, f, v in rows(3, 25, 20)]
    own, other = (spark.createDataFrame(x, SCHEMA) for x in (a, b))
    want = sorted((r.src, r.dst, r["rank"]) for r in nn.knn_sparse(own, 3, other, "none").collect())
    assert sorted((r.src, r.dst, r["rank"]) for r in si.knn_sparse_indexed(own, 3, other, "none").collect()) == want
    few = spark.createDataFrame(a[:2], SCHEMA)
    assert si.knn_sparse_indexed(few, 5).count() == 2 and si.knn_sparse_indexed(few.limit(0), 2).count() == 0


def test_negative_values_go_by_blocks(spark):
    df = spark.createDataFrame([(0, [1], [-1.0]), (1, [1], [2.0]), (2, [1, 2], [-2.0, 1.0])], SCHEMA)
    key = lambda d: sorted((r.src, r.dst, r["rank"]) for r in d.collect())
    assert key(si.knn_sparse_indexed(df, 1)) == key(nn.knn_sparse(df, 1))
    with pytest.raises(ValueError):
        si.knn_sparse_indexed(df, 0)


def test_bounds_spare_pairs(spark):
    # Long vectors that share one common feature only cannot be near a short one.
    rng = np.random.default_rng(5)
    data = [(i, [0, 1 + i % 10], [0.1, 5.0]) for i in range(100)] + [(100 + i, [0, *(20 + rng.choice(500, 9, replace=False)).tolist()], [0.1] + [9.0] * 9) for i in range(100)]
    df = spark.createDataFrame(data, SCHEMA)
    refs = si.rekey(df.withColumn("norm", si.total(si.F.transform("val", lambda x: x * x))).withColumn("order", si.F.struct("norm", "id")), "order", "n")
    refs = blocks.kept(refs)
    n = si.candidates(refs, refs, 3, True).count()
    # The common feature alone leads to no long reference, half of all pairs.
    assert n < 0.55 * 200 * 200
    got = sorted((r.src, r["rank"], round(r.dist, 9)) for r in si.knn_sparse_indexed(df, 3).collect())
    assert got == sorted((r.src, r["rank"], round(r.dist, 9)) for r in nn.knn_sparse(df, 3).collect())
