"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from . import measures, outputs, ranking, samples  # noqa: F401  (importing registers)
from .base import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
