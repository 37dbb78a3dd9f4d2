"""Weekly series: resampling, trailing statistics over observed weeks, runs, spines and as-of fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import times, vectors
from millrace.schemas import BASELINE_WEEKS, TREND_WEEKS


def weekly_mean(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, week (Monday), y: mean per observed week; weeks without a value are absent, not zero."""
    return rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(key, times.week_start(F.col(ts)).alias("week")).agg(F.avg(value).alias("y"))


def weekly_sum(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Like weekly_mean with sums: a week of NULLs only is absent."""
    return rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(key, times.week_start(F.col(ts)).alias("week")).agg(F.sum(value).alias("y"))


def trailing(weekly: DataFrame, key: str, baseline: int = BASELINE_WEEKS, trend: int = TREND_WEEKS) -> DataFrame:
    """Adds i (0-based), mean, std, flat, n of the `baseline` observed weeks before each week, and the percent change over `trend` observed weeks.

    Windows count observed weeks, so gaps are skipped; one shuffle on key serves all of them. A flat baseline is told by
    max = min, as its deviation may be a rounding remainder.
    """
    w = Window.partitionBy(key).orderBy("week")
    back = w.rowsBetween(-baseline, -1)
    out = weekly.withColumns({
        "i": F.row_number().over(w) - 1,
        "mean": F.avg("y").over(back),
        "std": F.stddev_pop("y").over(back),
        "flat": F.max("y").over(back) == F.min("y").over(back),
        "n": F.count("y").over(back),
        "trend": vectors.pct_change(F.col("y"), F.lag("y", trend).over(w)),
    })
    return out


def zscore(flat_rule: str = "null", baseline: int = BASELINE_WEEKS) -> Column:
    """z over `trailing` columns. A flat baseline gives NULL ('null', features) or inf above it and 0 otherwise ('inf', labels and backtest)."""
    z = (F.col("y") - F.col("mean")) / F.when(F.col("flat"), None).otherwise(F.col("std"))
    if flat_rule == "inf":
        z = F.when(F.col("flat"), F.when(F.col("y") > F.col("mean"), F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(z)
    return F.when(F.col("n") == baseline, z)


def runs(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Adds run (length of the maximal run of consecutive rows with flag true that the row lies in; 0 outside): gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, flag).orderBy(order))
    marked = rows.withColumn("_island", island)
    return marked.withColumn("run", F.when(F.col(flag), F.count("*").over(Window.partitionBy(key, flag, "_island"))).otherwise(F.lit(0))).drop("_island")


def spine(keys: DataFrame, first: Column, last: Column) -> DataFrame:
    """keys x Mondays, by exploding one sequence per key (no join)."""
    return keys.withColumn("week", F.explode(times.week_spine(first, last)))


def asof_fill(grid: DataFrame, weekly: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left-joins weekly to grid on (key, week) and carries the last row at or before each week forward, as one struct."""
    held = F.struct(F.col("week").alias("asof_week"), *columns)
    joined = grid.join(weekly.select(key, "week", held.alias("_s")), [key, "week"], "left")
    w = Window.partitionBy(key).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    filled = joined.withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return filled.select(*grid.columns, F.col("_s.asof_week").alias("asof_week"), *(F.col(f"_s.{c}").alias(c) for c in columns))
