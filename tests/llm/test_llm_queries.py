"""Every corpus query runs on the smallest tables and equals its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import compare, duck

queries = pytest.importorskip("litweave.llm.queries")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, DIR, name, queries.QUERIES[name], queries.ORACLE.get(name), duck(DIR))
    assert ok, said


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
