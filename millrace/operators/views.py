"""Read views: one row per resource, nested detail, alert feed, timelines, benchmark table, case studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators.forecast import collapse_status
from millrace.schemas import RISK_TIERS, STATUS_PRIORITY


def latest(rows: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """Latest row per group by (ts, tie), as one aggregate over structs: no sort, partial results before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_s")).select(*by, *(F.col(f"_s.{c}").alias(c) for c in rest))


def latest_runs(forecasts: DataFrame) -> DataFrame:
    """All rows of the latest run per (resource, series type)."""
    w = Window.partitionBy("resource_id", "series_type")
    return forecasts.withColumn("_m", F.max("run_at").over(w)).where("run_at = _m").drop("_m")


def forecast_summary(rows: DataFrame) -> DataFrame:
    """point falls back to the second model, whose interval is unknown."""
    has = F.col("prophet_point").isNotNull()
    return rows.select("resource_id", "series_type", "horizon", F.coalesce("prophet_point", "holt_winters_point").alias("point"), F.when(has, F.col("prophet_lower")).alias("lower"), F.when(has, F.col("prophet_upper")).alias("upper"), "status", "disagreement_pct")


def leaderboard(resources: DataFrame, predictions: DataFrame, runs: DataFrame, forecasts: DataFrame, explanations: DataFrame) -> DataFrame:
    """Every resource once: latest prediction with its model's mode, forecast status by series, explanation status."""
    p = latest(predictions.join(runs.select("run_id", "data_mode"), "run_id"), ["resource_id"], "predicted_at", "id")
    s = collapse_status(latest_runs(forecasts), ["resource_id", "series_type"], STATUS_PRIORITY)
    f = s.groupBy("resource_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series_type", "status")))).alias("forecast_status"))
    e = latest(explanations, ["resource_id"], "generated_at", "id")
    out = resources.select("resource_id", "name").join(p.select("resource_id", "calibrated_probability", "data_mode", "predicted_at"), "resource_id", "left").join(f, "resource_id", "left").join(e.select("resource_id", F.col("status").alias("explanation")), "resource_id", "left")
    return out.select("resource_id", "name", "calibrated_probability", (F.col("data_mode") == "real").alias("is_real_data_model"), "predicted_at", V.risk_tier(F.col("calibrated_probability"), RISK_TIERS).alias("tier"), F.coalesce("forecast_status", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("forecast_status"), F.coalesce("explanation", F.lit("not_attempted")).alias("explanation_status"))


def detail(resources: DataFrame, prices: DataFrame, forecasts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Nested price history, forecast breakdown and episodes per resource."""
    ph = prices.groupBy("resource_id").agg(F.sort_array(F.collect_list(F.struct("ts", "price_usd"))).alias("price_history"))
    fb = forecast_summary(latest_runs(forecasts)).groupBy("resource_id").agg(F.sort_array(F.collect_list(F.struct("series_type", "horizon", "point", "lower", "upper", "status"))).alias("forecasts"))
    ep = episodes.groupBy("resource_id").agg(F.sort_array(F.collect_list(F.struct("start_week", "end_week", "episode_name"))).alias("episodes"))
    return resources.join(ph, "resource_id", "left").join(fb, "resource_id", "left").join(ep, "resource_id", "left")


def with_list(rows: DataFrame, many: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the sorted distinct values of many's column under their key; an empty array where there are none."""
    per = many.where(F.col(column).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(column)).alias(column))  # distinct values of a key
    kind = dict(many.dtypes)[column]
    return rows.join(per, key, "left").withColumn(column, F.coalesce(column, F.array().cast(f"array<{kind}>")))


def all_resources(resources: DataFrame) -> DataFrame:
    return resources.select("resource_id", F.coalesce("name", "resource_id").alias("name")).orderBy("resource_id")


def resource_summary(board: DataFrame, resource_id: str) -> DataFrame:
    """One resource's row of the leaderboard; none for an unknown resource."""
    return board.where(F.col("resource_id") == resource_id)


def historical_context(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Episodes as first and last labelled week per justification, named by it."""
    g = labels.where("label = 1 and source = 'curated_episode'").groupBy("resource_id", "justification").agg(F.min("week_start").alias("start_week"), F.max("week_start").alias("end_week"))
    return g.join(names, "justification", "left").select("resource_id", "episode_name", "start_week", "end_week")


def alert_feed(predictions: DataFrame, explanations: DataFrame, resources: DataFrame, limit: int = 20) -> DataFrame:
    """Predictions and explanations as one feed, latest first, NULL times last, never padded."""
    p = predictions.select(F.lit("prediction").alias("kind"), "resource_id", F.col("predicted_at").alias("at"), F.concat(F.lit("probability "), X.percent(F.col("calibrated_probability"))).alias("summary"), F.col("id"))
    e = explanations.select(F.lit("explanation").alias("kind"), "resource_id", F.col("generated_at").alias("at"), F.left(F.coalesce("narrative", "status"), F.lit(200)).alias("summary"), F.col("id"))
    feed = p.unionByName(e).orderBy(F.desc_nulls_last("at"), "kind", "id").limit(limit)
    return feed.join(resources.select("resource_id", "name"), "resource_id", "left").select("kind", "resource_id", F.coalesce("name", "resource_id").alias("name"), "at", "summary", "id")


def latest_scores(timeline: DataFrame) -> DataFrame:
    return latest(timeline, ["resource_id"], "week", "risk_score").withColumn("tier", V.risk_tier(F.col("risk_score"), RISK_TIERS))


def benchmark_table(metrics: DataFrame) -> DataFrame:
    """Metrics by F1, best first, the best starred."""
    best = metrics.agg(F.max_by("model", F.struct("f1", "roc_auc", "model")).alias("b"))
    return metrics.join(F.broadcast(best)).withColumn("best", F.col("model") == F.col("b")).drop("b").orderBy(F.desc("f1"), "model")  # best: one row


def case_studies(timeline: DataFrame, events: DataFrame) -> DataFrame:
    """Timeline rows of each event's resources, flagged where the event was on. events(event, resource_ids, start, end)."""
    e = events.select("event", F.explode("resource_ids").alias("resource_id"), "start", "end")
    return timeline.join(F.broadcast(e) if e.limit(10_001).count() <= 10_000 else e, "resource_id").withColumn("during", F.col("week").between(F.col("start"), F.col("end")))


def status_sentence(status: Column, known: dict[str, str], what: str) -> Column:
    """Plain sentence per status; an unknown one is shown as such."""
    m = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(m, status), F.concat(F.lit(f"⚠ Unrecognized {what} status: '"), status, F.lit("'")))


# Texts of the read contract.
FORECAST_SENTENCES = {
    "ok": "Forecast available.",
    "insufficient_data": "Not enough history to forecast.",
    "model_error": "Forecast model failed to run.",
    "unstable_disagreement": "Forecast unstable — the two models disagree sharply.",
}
EXPLANATION_SENTENCES = {
    "ok": "Explanation generated.",
    "not_attempted": "No explanation has been generated for this resource yet.",
    "insufficient_evidence": "Explanation attempted, but no qualifying evidence was found.",
    "llm_error": "Explanation could not be generated (the language-model call failed).",
    "invalid_citations": "Explanation was rejected because its citations could not be verified.",
}
FEATURE_NAMES = {
    "price_latest": "Price level",
    "price_trend_4w": "Price trend (4w)",
    "price_zscore_8w": "Price z-score (8w)",
    "forecast_point_1m": "Forecast (1m)",
    "forecast_interval_width_1m": "Forecast uncertainty (1m)",
    "forecast_disagreement_1m": "Forecast disagreement (1m)",
    "forecast_unstable_flag": "Forecast unstable flag",
    "signal_severity_mean_4w": "News severity (4w)",
    "signal_count_4w": "News volume (4w)",
    "hhi_country": "Supplier concentration (HHI)",
}
