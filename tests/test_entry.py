"""The entry points."""

import importlib.util

import __spark_entry__ as entry


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "driftwell.llm" else real(name, *a))
    assert entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "n", "vr_eff", "lb_eff", "vr_std"] and df.count() > 0
