"""Every query against its SQL on the given tables."""

from __future__ import annotations

import parity
import pytest
from conftest import plan_of

import __spark_entry__ as entry_points
from marginalia.catalog.oracles import ORACLES
from marginalia.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return parity.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert parity.difference(frame, duck, ORACLES[name]) is None


def test_entry_returns_rows(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["section", "rank", "key", "score", "title", "authors", "abstract", "url", "date"]
    assert result.count() > 0
