"""Every registered query against its SQL twin, on the smallest driver tables."""

import os

import pytest

from oddsframe.plans import load_all
from oddsframe.plans.registry import ORACLES, QUERIES
from tests import oracle

load_all()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    oracle.SF_DIR = os.environ.get("ORACLE_SF_DIR", SMALL)
    return oracle.duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    rows, problem = oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name))
    assert not problem, problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
