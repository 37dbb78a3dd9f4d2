"""The as-of feature row as one set-based plan, the training table, splits and timelines.

Every value at a week depends on rows up to that week's Sunday alone; tests add later rows and require the same output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import weekly as W
from millrace.schemas import FEATURES


def price_features(prices: DataFrame) -> DataFrame:
    """prices(resource_id, ts, price_usd) -> resource_id, week, price_latest, price_trend_4w, price_zscore_8w per observed week."""
    t = W.trailing(W.weekly_mean(prices, "resource_id", "ts", "price_usd"), "resource_id")
    return t.select("resource_id", "week", F.col("y").alias("price_latest"), F.col("trend").alias("price_trend_4w"), W.zscore("null").alias("price_zscore_8w"))


def signal_features(grid: DataFrame, signals: DataFrame, gate: str = "asof") -> DataFrame:
    """Mean severity and count of scored signals in the four ISO weeks that end with each grid week.

    28 days up to a Sunday are four whole weeks, so weekly sums are added to each of the four weeks they count for: an equi-join
    instead of a range join. Without any scored signal up to the week (gate 'asof') or at all ('global'), both are NULL.
    """
    scored = signals.where("severity is not null and ts is not null").groupBy("resource_id", times.week_start(F.col("ts")).alias("wk")).agg(F.sum("severity").alias("s"), F.count("*").alias("c"))
    spread = scored.withColumn("week", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.date_add("wk", 7 * k))))
    sums = spread.groupBy("resource_id", "week").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    first = scored.groupBy("resource_id").agg(F.min("wk").alias("first_scored"))
    out = grid.join(sums, ["resource_id", "week"], "left").join(first, "resource_id", "left")
    known = F.col("first_scored").isNotNull() if gate == "global" else F.col("first_scored") <= F.col("week")
    return out.select(*grid.columns, (F.col("s") / F.col("c")).alias("signal_severity_mean_4w"), F.when(known, F.coalesce("c", F.lit(0)).cast("double")).alias("signal_count_4w"))


def forecast_features(grid: DataFrame, forecasts: DataFrame) -> DataFrame:
    """As-of forecast columns: of the runs up to the week's Sunday, the latest 1m values, and whether any run was unstable.

    Runs are folded to their week first, then carried forward by one window per resource.
    """
    usable = F.col("status").isin("ok", "unstable_disagreement") & (F.col("horizon") == "1m")
    last = lambda c: F.max_by(F.col(c), F.when(usable & F.col(c).isNotNull(), F.struct("run_at", c)))
    f = forecasts.withColumn("width", F.col("prophet_upper") - F.col("prophet_lower"))
    per = f.groupBy("resource_id", times.week_start(F.col("run_at")).alias("week")).agg(
        last("prophet_point").alias("p"), last("width").alias("w"), last("disagreement_pct").alias("d"),
        F.max((F.col("status") == "unstable_disagreement").cast("int")).alias("u"), F.max((F.col("status") == "ok").cast("int")).alias("o"))
    joined = grid.join(per, ["resource_id", "week"], "full")
    w = Window.partitionBy("resource_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.last(c, ignorenulls=True).over(w) for c in ("p", "w", "d")} | {c: F.max(c).over(w) for c in ("u", "o")}
    out = joined.select("resource_id", "week", *(v.alias(k) for k, v in held.items()))
    out = out.select("resource_id", "week", F.col("p").alias("forecast_point_1m"), F.col("w").alias("forecast_interval_width_1m"), F.col("d").alias("forecast_disagreement_1m"), F.when(F.col("u") == 1, 1.0).when(F.col("o") == 1, 0.0).alias("forecast_unstable_flag"))
    return grid.join(out, ["resource_id", "week"], "left")


def feature_rows(grid: DataFrame, prices: DataFrame, signals: DataFrame, forecasts: DataFrame, resources: DataFrame, gate: str = "asof") -> DataFrame:
    """grid(resource_id, week) -> the ten features of every grid row."""
    columns = ["price_latest", "price_trend_4w", "price_zscore_8w"]
    # As-of fill needs the observed weeks in the grid too; they are taken out again at the end.
    observed = price_features(prices)
    both = grid.select("resource_id", "week").withColumn("_in", F.lit(True)).unionByName(observed.select("resource_id", "week").withColumn("_in", F.lit(False))).groupBy("resource_id", "week").agg(F.max("_in").alias("_in"))
    out = W.asof_fill(both, observed, "resource_id", columns).where("_in").drop("_in", "asof_week")
    out = signal_features(forecast_features(out, forecasts), signals, gate)
    return out.join(resources.select("resource_id", "hhi_country"), "resource_id", "left").select("resource_id", "week", *FEATURES)


def training_table(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels with status ok joined to their week's features; rows without a price are not usable."""
    ok = labels.where("status = 'ok' and label is not null").select("resource_id", F.col("week_start").alias("week"), "label", F.col("source").alias("label_source"))
    return ok.join(features, ["resource_id", "week"]).where("price_latest is not null")


def chronological_split(rows: DataFrame, test_ratio: float = 0.2) -> DataFrame:
    """Adds part: the first floor(n * (1 - ratio)) rows by (week, resource) train, the rest test.

    Ranks come from per-week counts (one row a week meets in one place), not from a global sort of the rows.
    """
    counts = rows.groupBy("week").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("week", before.alias("_before"), F.sum("c").over(Window.partitionBy()).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("week").orderBy("resource_id", *[c for c in ("label_source",) if c in rows.columns]))
    out = rows.withColumn("_r", rank).join(placed, "week")
    train = F.col("_before") + F.col("_r") <= F.floor(F.round(F.col("_n") * (1 - test_ratio), 9))
    return out.withColumn("part", F.when(train, "train").otherwise("test")).drop("_r", "_before", "_n")


def timeline(resources: DataFrame, first: Column, last: Column) -> DataFrame:
    """resources x Mondays from first's week to last."""
    return W.spine(resources.select("resource_id"), first, last)


def asof_bundle(prices: DataFrame, signals: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoffs(resource_id, cutoff) -> the nine as-of facts of each, from rows at or before the cutoff (unparsable stamps left out)."""
    from millrace.operators.labels import price_anomalies

    p = cutoffs.join(prices, "resource_id").where("ts is not null and ts <= cutoff").withColumn("key", F.concat_ws("\x00", "resource_id", F.col("cutoff").cast("string")))
    weekly = W.weekly_mean(p, "key", "ts", "price_usd")
    latest = price_anomalies(weekly, "key").groupBy("key").agg(F.count("*").alias("n_price_points"), F.max_by("y", "week").alias("y"), F.max_by(F.struct("z", "label"), "week").alias("last"))
    dates = p.groupBy("key").agg(F.to_date(F.max("ts")).alias("latest_price_date"))
    s = cutoffs.join(signals, "resource_id").where("ts is not null and ts <= cutoff").groupBy("resource_id", "cutoff").agg(F.count("*").alias("n_signals"), F.count("severity").alias("n_scored_signals"), F.round(F.avg("severity"), 6).alias("mean_severity"))
    out = cutoffs.withColumn("key", F.concat_ws("\x00", "resource_id", F.col("cutoff").cast("string"))).join(latest, "key", "left").join(dates, "key", "left").join(s, ["resource_id", "cutoff"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("resource_id", "cutoff", zero("n_price_points"), F.round("y", 6).alias("latest_price"), "latest_price_date", F.round("last.z", 6).alias("price_zscore_latest"), F.col("last.label").alias("anomaly_label_latest"), zero("n_signals"), zero("n_scored_signals"), "mean_severity")


def compare_outcome(bundle: DataFrame, direction: DataFrame, episodes: DataFrame) -> DataFrame:
    """Whether an as-of tightening signal is present (anomaly, rising forecast or z >= 2) and meets a known episode."""
    d = bundle.join(direction, ["resource_id", "cutoff"], "left").join(episodes.select("resource_id").distinct().withColumn("known", F.lit(True)), "resource_id", "left")
    present = F.coalesce(F.col("anomaly_label_latest") == 1, F.lit(False)) | F.coalesce(F.col("direction") == "rising", F.lit(False)) | F.coalesce(F.col("price_zscore_latest") >= 2.0, F.lit(False))
    return d.select("resource_id", "cutoff", F.when(F.col("known"), "tightening").otherwise("unknown").alias("expected_outcome"), F.when(present, "tightening_signal_present").otherwise("no_tightening_signal").alias("observed_signal"), (present & F.coalesce("known", F.lit(False))).alias("direction_match"))
