"""Every registered query against its SQL, and those without SQL for rows and repeatability."""

from __future__ import annotations

import pytest

from quillon import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_repeats(name, spark, sf):
    one = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    two = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert one and one == two


def test_entry(spark, sf):
    frame = catalog.entry(spark, sf)
    assert frame.columns == ["qid", "id", "rank", "score"] and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
