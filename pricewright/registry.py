"""Where queries over the test tables, and the same in SQL, are registered."""

from __future__ import annotations

from .sources.retail import with_views

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql.strip())
        return f

    return add
