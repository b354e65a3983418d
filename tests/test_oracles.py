"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, queries()[name], ORACLES.get(name))
    assert ok, text


def test_entry(spark):
    assert entry(spark).count() > 0


def test_all_but_document_queries_have_an_oracle():
    documents = {q for q in queries() if q.startswith("op") or q == "pipeline"}  # see tests/llm
    assert set(queries()) - set(ORACLES) - documents == set()
