"""Every query with a DuckDB counterpart returns the same rows, on the smallest tables."""

from __future__ import annotations

import pytest

from pulsegrid.plans import clinical, modelling, registry, storage, vitals  # noqa: F401
from tests.compare import differ, duck

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"dq4_split_group_leakage", "join14_overlapping_versions", "dq4_split_leakage", "dq4_inconsistent_versions", "agg23_health_gate"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_counterpart(spark, con, name):
    said = differ(con, registry.QUERIES[name], registry.ORACLES[name], spark, SF)
    assert said == "" or (said == "no rows" and name in MAY_BE_EMPTY), said


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_does_not_need_the_optional_parts(monkeypatch):
    import sys

    for gone in ("corpus_pipeline", "pulsegrid.llm", "pulsegrid.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
