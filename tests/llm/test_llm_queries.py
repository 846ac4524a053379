"""Registered queries against their SQL, and the entry's guard."""

from __future__ import annotations

import pytest

from quillon.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, same):
    assert same(registry.queries()[name](spark, sf), registry.oracle_sql()[name]) > 0


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(registry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_entry_adds_them():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
