"""The driver's entry without the training-data subpackage."""

import sys

import __spark_entry__ as entry
from isoflow.plans import registry


def test_what_cannot_be_imported_is_left_out(monkeypatch):
    for name in ("isoflow.llm", "isoflow.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    assert entry.queries() == registry.QUERIES and entry.oracle_sql() == registry.ORACLE


def test_the_pipeline_alone_may_be_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(registry.QUERIES) <= set(entry.queries())
