"""The driver contract with and without the optional training-data part."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry
from handbook_spark.plans import registry


def fresh(monkeypatch, *blocked: str):
    """The entry module imported anew, with some modules that cannot be imported."""
    for name in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("handbook_spark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in blocked:
        monkeypatch.setitem(sys.modules, name, None)
    return importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("package", ["zstandard", "regex", "handbook_spark.llm"])
def test_a_missing_package_leaves_the_other_queries(monkeypatch, package):
    with pytest.warns(UserWarning, match="left out"):
        module = fresh(monkeypatch, package)
    assert set(module.queries()) == set(registry.queries())
    assert set(module.oracle_sql()) == set(registry.oracle_sql())


def test_a_missing_pipeline_leaves_the_training_data_queries(monkeypatch):
    if entry.llm is None:
        pytest.skip("no training-data part")
    with pytest.warns(UserWarning, match="pipeline"):
        module = fresh(monkeypatch, "corpus_pipeline")
    assert "pipeline" not in module.queries() and set(module.queries()) > set(registry.queries())


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) == len(registry.oracle_sql())
