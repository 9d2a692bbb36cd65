"""Where queries and their SQL register."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
