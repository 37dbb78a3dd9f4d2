"""Table contracts: column types, keys and closed sets of the early-warning model. Unknown is NULL everywhere, never 0 or NaN."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Closed sets and thresholds.
SIGNAL_TYPES = ("news_raw", "capacity_expansion", "demand_intent_raw")
EVENT_TYPES = ("supply_disruption", "demand_signal", "price_movement", "regulatory_policy", "other")
FORECAST_STATUS = ("ok", "insufficient_data", "unstable_disagreement", "model_error")
STATUS_PRIORITY = ("model_error", "insufficient_data", "unstable_disagreement", "ok")
LABEL_SOURCES = ("curated_episode", "price_derived")
LABEL_STATUS = ("ok", "insufficient_data")
EXPLANATION_STATUS = ("ok", "insufficient_evidence", "llm_error", "invalid_citations", "not_attempted")
DATA_MODES = ("real", "synthetic_validation")
HORIZONS = {"2w": 2, "1m": 4, "3m": 13, "6m": 26}
PRICE_UNIT = "USD_per_share_proxy"
FEATURES = ("price_latest", "price_trend_4w", "price_zscore_8w", "forecast_point_1m", "forecast_interval_width_1m", "forecast_disagreement_1m", "forecast_unstable_flag", "signal_severity_mean_4w", "signal_count_4w", "hhi_country")
BASELINE_WEEKS, TREND_WEEKS, MIN_RUN, Z_GATE = 8, 4, 3, 2.0
MIN_POINTS, DISAGREEMENT_GATE = 12, 25.0
NEAR_DUPLICATE, MIN_RETRIEVAL, MIN_EMBEDDING_MATCH = 0.83, 0.30, 0.45
MIN_DENSITY_ROWS = 40
MIN_REAL_ROWS = 50
RISK_TIERS = ((0.3, "Safe"), (0.6, "Watch"), (0.8, "Elevated"))


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    refs: tuple[tuple[str, str, str], ...] = ()


TABLES: dict[str, Table] = {
    "resource": Table("resource_id string, name string, category string, hs_codes array<string>, aliases array<string>, substitutes array<string>, hhi_country double, top_producing_countries array<struct<country:string,share:double>>, expansion_lead_time_months int", ("resource_id",)),
    "producer": Table("producer_id string, name string, tickers array<string>", ("producer_id",)),
    "producer_resource": Table("producer_id string, resource_id string", ("producer_id", "resource_id"), (("producer_id", "producer", "producer_id"), ("resource_id", "resource", "resource_id"))),
    "facility": Table("facility_id long, producer_id string, country string, city string", ("facility_id",), (("producer_id", "producer", "producer_id"),)),
    "signal": Table("signal_id long, timestamp string, ts timestamp, signal_type string, resource_id string, producer_id string, country string, value double, unit string, severity double, confidence double, source_name string, source_url string, raw_text string, ingested_at timestamp", ("signal_id",), (("resource_id", "resource", "resource_id"),)),
    "price_series": Table("id long, resource_id string, timestamp string, ts timestamp, price_usd double, unit string, source string", ("id",)),
    "capacity_record": Table("id long, producer_id string, resource_id string, year int, capacity_value double, unit string, source string", ("id",)),
    "news_cluster_membership": Table("signal_id long, cluster_id string, is_canonical boolean, processed_at timestamp", ("signal_id",)),
    "event_extraction": Table("signal_id long, event_type string, extracted_entities array<string>, llm_provider string, llm_model string, raw_llm_response string, extracted_at timestamp", ("signal_id",)),
    "forecast_result": Table("resource_id string, series_type string, horizon string, run_at timestamp, prophet_point double, prophet_lower double, prophet_upper double, holt_winters_point double, chronos_point double, disagreement_pct double, status string, notes string", ("resource_id", "series_type", "horizon", "run_at")),
    "label": Table("resource_id string, week_start date, label int, source string, status string, justification string, created_at timestamp", ("resource_id", "week_start", "source")),
    "training_run": Table("run_id string, run_at timestamp, data_mode string, n_examples long, n_positive long, date_from date, date_to date, random_seed int, model_path string, calibration_applied boolean, notes string", ("run_id",)),
    "prediction": Table("id long, run_id string, resource_id string, week_start date, horizon string, raw_score double, calibrated_probability double, top_shap_features array<struct<feature:string,contribution:double>>, predicted_at timestamp", ("id",), (("run_id", "training_run", "run_id"),)),
    "explanation": Table("id long, resource_id string, prediction_id long, narrative string, citations array<struct<signal_id:long,excerpt:string>>, evidence_count int, llm_provider string, is_real_data_model boolean, status string, generated_at timestamp", ("id",)),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].ddl)


def init(spark: SparkSession, root: str) -> None:
    """Replaces every table under root by an empty one; running it again changes nothing."""
    for name in TABLES:
        empty(spark, name).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def is_nullable(df: DataFrame, column: str) -> bool:
    """Schema introspection; a column that is absent counts as nullable (it can be added)."""
    return column not in df.columns or df.schema[column].nullable
