"""A run as named stages with a status each: done, skipped (with the reason) or error; later stages still run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STAGES = ("ingest", "understand", "engineer", "label", "predict", "explain", "deliver")


class Skip(Exception):
    """Raised by a stage that has nothing to do."""


def run(spark: SparkSession, steps: dict[str, Callable[[dict], str]]) -> tuple[DataFrame, dict]:
    """Runs the known stages in order over one shared context; returns (stage, position, status, detail) and the context."""
    context: dict = {}
    rows = []
    for i, name in enumerate(STAGES):
        step = steps.get(name)
        if step is None:
            rows.append((name, i, "skipped", "not configured"))
            continue
        try:
            rows.append((name, i, "done", str(step(context))))
        except Skip as why:
            rows.append((name, i, "skipped", str(why)))
        except Exception as why:
            rows.append((name, i, "error", f"{type(why).__name__}: {why}"[:500]))
    return spark.createDataFrame(rows, "stage string, position int, status string, detail string"), context
