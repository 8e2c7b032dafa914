"""Every registered engine query against its SQL on the small tables."""

import oracle
import pytest
from oracle import SF

from causelake import model_queries, unit_queries  # noqa: F401 - register
from causelake.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ok, got, want = oracle.compare(spark, name, SF, QUERIES, ORACLES, con)
    assert ok, (got[0], sorted(map(str, got[1]))[:3], sorted(map(str, want[1]))[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"response_curve", "distance_match"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).limit(5).collect()
