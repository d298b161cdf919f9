"""Queries by name, each with the DuckDB SQL that checks it (none where SQL can't express it)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
