"""Registered corpus queries against their SQL twins on the smallest driver tables."""

import pytest

from oddsframe.llm.queries import ORACLES, QUERIES
from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "SF_DIR", SMALL)
    _, problem = oracle.compare(spark, oracle.duck(), name, QUERIES[name], ORACLES[name])
    assert not problem, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith(("op8", "op11")) else "documents"
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    key = "page_id" if table == "pages" else "doc_id"
    found = QUERIES[name](spark, SMALL)
    assert found.select(key).distinct().count() == rows
