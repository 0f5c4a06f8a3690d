"""Every query of the core runs on the smallest tables and equals its SQL."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest
from compare import compare, duck

from litweave.plans import check_queries, data_queries, graph_queries, lookup_queries, measure_queries, text_queries

DIR = "/root/testdata/sf0.001"
MODULES = (lookup_queries, graph_queries, measure_queries, text_queries, data_queries, check_queries)
QUERIES = {k: (f, m.ORACLE.get(k)) for m in MODULES for k, f in m.QUERIES.items()}

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    f, sql = QUERIES[name]
    ok, said = compare(spark, DIR, name, f, sql, con)
    assert ok, said


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["v", "score"]


def test_core_does_not_import_llm():
    root = Path(importlib.util.find_spec("litweave").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "litweave.llm" not in p.read_text()
