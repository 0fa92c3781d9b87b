"""All registered queries, imported in one place."""

from __future__ import annotations

from quarry.plans import (answering, evaluation, ingest, layout_dialogue, retrieval,  # noqa: F401
                          streams, vector_search)
from quarry.plans.registry import NOTES, ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def notes():
    return dict(NOTES)
