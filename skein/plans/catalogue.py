"""The list of queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

ALL: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its twin in SQL where there is one."""

    def add(f):
        if name in ALL:
            raise ValueError(f"{name} is registered twice")
        ALL[name] = (f, sql)
        return f

    return add
