"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules that have QUERIES, and ORACLE_SQL where there is any.
MODULES = ("chat", "html", "language", "decontaminate", "bpe", "secrets", "media", "licenses", "neardup", "quality")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
