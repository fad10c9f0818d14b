"""Where queries are registered: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return add
