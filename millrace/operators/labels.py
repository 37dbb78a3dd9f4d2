"""Labels: curated episodes, price anomalies, disagreement between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import weekly as W
from millrace.schemas import BASELINE_WEEKS, MIN_RUN, Z_GATE


def expand_periods(periods: DataFrame, lead_weeks: int) -> DataFrame:
    """periods(resource_id, start_date, end_date, label, justification) -> weekly labels.

    Tightening periods (label 1) start lead_weeks early, others on their date. Where periods of a resource overlap, label 1 wins,
    then the earlier period.
    """
    start = F.date_sub(F.col("start_date"), 7 * F.when(F.col("label") == 1, lead_weeks).otherwise(0))
    rows = periods.withColumn("week_start", F.explode(times.week_spine(start, F.col("end_date"))))
    w = Window.partitionBy("resource_id", "week_start").orderBy(F.desc("label"), "start_date", "justification")
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select("resource_id", "week_start", F.col("label").cast("int").alias("label"), F.lit("curated_episode").alias("source"), F.lit("ok").alias("status"), "justification")


def price_anomalies(weekly: DataFrame, key: str = "resource_id") -> DataFrame:
    """key, week, y, z, label, status, justification: label 1 in runs of at least MIN_RUN weeks with z > Z_GATE; NULL while history is short."""
    t = W.trailing(weekly, key).withColumn("z", W.zscore("inf"))
    t = t.withColumn("ready", F.col("i") >= BASELINE_WEEKS).withColumn("elevated", F.col("ready") & F.coalesce(F.col("z") > Z_GATE, F.lit(False)))
    t = W.runs(t, key, "week", "elevated")
    hot = F.col("run") >= MIN_RUN
    label = F.when(F.col("ready"), F.when(hot, 1).otherwise(0))
    shown = F.when(F.col("z") == float("inf"), "inf").otherwise(F.format_string("%.2f", "z"))
    why = (
        F.when(~F.col("ready"), f"< {BASELINE_WEEKS} trailing weeks of history")
        .when(hot, F.concat(F.lit("z-score "), shown, F.lit(f" > {Z_GATE} sustained >= {MIN_RUN} consecutive weeks")))
        .otherwise(F.concat(F.lit("z-score "), shown, F.when(F.col("elevated"), "; elevated but not sustained").otherwise("; not elevated")))
    )
    return t.select(key, "week", "y", "z", label.alias("label"), F.when(F.col("ready"), "ok").otherwise("insufficient_data").alias("status"), why.alias("justification"))


def disagreements(labels: DataFrame) -> DataFrame:
    """Weeks that two sources label differently: resource_id, week_start, source, label, other_source, other_label (source < other_source)."""
    c, p = labels.where("status = 'ok'").alias("c"), labels.where("status = 'ok'").alias("p")
    on = [F.col("c.resource_id") == F.col("p.resource_id"), F.col("c.week_start") == F.col("p.week_start"), F.col("c.source") < F.col("p.source"), F.col("c.label") != F.col("p.label")]
    return c.join(p, on).select("c.resource_id", "c.week_start", "c.source", "c.label", F.col("p.source").alias("other_source"), F.col("p.label").alias("other_label"))


def uncovered(labels: DataFrame, weekly: DataFrame) -> DataFrame:
    """Label rows whose week has no price: resource_id and count of weeks."""
    return labels.join(weekly.select("resource_id", F.col("week").alias("week_start")), ["resource_id", "week_start"], "left_anti").groupBy("resource_id").agg(F.count("*").alias("n"))


def prefer_source(labels: DataFrame, order: tuple[str, ...] = ("curated_episode", "price_derived")) -> DataFrame:
    """One row per (resource, week): the first source in `order` wins."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    w = Window.partitionBy("resource_id", "week_start").orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), "source")
    return labels.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
