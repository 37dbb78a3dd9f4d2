"""All registered queries of the library, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from millrace.queries import ORACLES, QUERIES, outputs, relational, series, textual

__all__ = ["ORACLES", "QUERIES", "outputs", "relational", "series", "textual"]
