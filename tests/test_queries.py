"""Every registered query against its SQL; those without SQL must give rows and a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.oracle import assert_same, connection
from wearline import queries as core

NAMES = list(core.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    found = core.queries()[name](spark, sf).toPandas()
    if name in core.oracle_sql():
        assert_same(found, duck.sql(core.oracle_sql()[name]).df())
    else:
        assert len(found) > 0


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns[:2] == ["cycle_id", "pos"]
    assert found.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
