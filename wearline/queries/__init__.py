"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from wearline.queries import building, evaluation, features
from wearline.queries.common import QUERIES, SQL
from wearline.queries.features import flagship

__all__ = ["building", "evaluation", "features", "flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
