import sys

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.oracle_sql()) > 80


def test_entry_works_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(__spark_entry__.queries())
    assert "flagship_split_report" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
