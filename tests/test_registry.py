"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from isoflow.plans.registry import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert rows(QUERIES[name](spark, str(SF)).toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
