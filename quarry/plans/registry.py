"""Named queries and their DuckDB twins.

A query is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables.
Its oracle, when SQL can express it, is registered next to it, so the
two are written and reviewed together.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
NOTES: dict[str, str] = {}


def register(name: str, sql: str | None = None, note: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if note:
            NOTES[name] = note
        return fn
    return deco
