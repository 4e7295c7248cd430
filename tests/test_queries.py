"""Every query with SQL against its twin; the others by shape."""

import importlib.util

import pytest

from orrery.plans import catalogue
from tests.conftest import DATA, DATA_1

ROWS = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))
#: Large grids; their operators are tested with small parameters in test_clusters.py, test_tracking.py and test_relations.py.
SLOW = {"gbt_gap", "gap_stability", "rf_importance", "compare_methods", "rule_search", "bootstrap_confidence", "stability", "synthetic_recovery", "index_recovery", "truth_recovery", "truth_wins"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, same_rows, name):
    same_rows(catalogue.QUERIES[name](spark, DATA_1).toPandas(), duck(catalogue.ORACLES[name], DATA_1))


@pytest.mark.parametrize("name", [n for n in ROWS if n not in SLOW])
def test_rows(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", __import__("os").path.join(__import__("os").path.dirname(__file__), "..", "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() == 1
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_parts():
    """Nothing outside the corpus subpackage imports it."""
    import pathlib
    import re

    top = pathlib.Path(__file__).parent.parent / "orrery"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert not re.search(r"^\s*(from|import)\s+orrery\.llm|from orrery import .*llm", p.read_text(), re.M), p
