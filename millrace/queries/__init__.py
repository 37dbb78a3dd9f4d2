"""Registered queries: every operator applied to the benchmark tables, beside its DuckDB equivalent.

Stand-ins: orders by priority are the price series, line items are scored signals, orders of three states are forecast rows.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
