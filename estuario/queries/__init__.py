"""Registry of the core's queries and of the SQL they are checked against."""

from __future__ import annotations

from . import analysis, data_problems, layers, primitives, quality, storage

MODULES = [data_problems, layers, analysis, primitives, quality, storage]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
