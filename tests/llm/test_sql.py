"""Every corpus query that has SQL against it."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, connection
from wearline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, sf):
    assert_same(registry.queries()[name](spark, sf).toPandas(), connection(sf).sql(registry.oracle_sql()[name]).df())
