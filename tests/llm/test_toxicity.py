"""The toxicity model does not change when a labelled row is repeated."""

from isoflow.llm import toxicity


def test_repeated_rows_do_not_weigh(spark):
    rows = [(i, f"plain words {i}" + (" vile" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    fits = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + [r for r in rows if r[0] in (1, 2, 3)] * 20)]
    assert all((a == b).all() for a, b in zip(*fits))
