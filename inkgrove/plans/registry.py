"""All queries of the core library and their SQL."""

from __future__ import annotations

from inkgrove.plans import corpus, formats, parsing, records

MODULES = [records, parsing, formats, corpus]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
