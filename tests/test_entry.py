import importlib
import os
import sys


def test_names_agree():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "sliding_count" in e.queries() and not any(n.startswith("op") for n in e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert importlib.import_module("__spark_entry__").entry(spark).count() > 0
