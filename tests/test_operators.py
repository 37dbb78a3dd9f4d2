"""Operators: invariants (no look-ahead, idempotence, partition of unity) and hand-made vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, features, forecast, labels, metrics, text, views
from millrace.operators import weekly as W
from millrace.sources import readers, sinks

MONDAY = dt.date(2023, 1, 2)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, MONDAY + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(values)], "resource_id string, week date, y double")


@pytest.mark.parametrize(("values", "expect"), [
    ([100] * 12 + [130, 145, 160, 175], [None] * 8 + [0] * 4 + [1] * 4),
    ([100] * 7, [None] * 7),
    ([100] * 12 + [200] + [100] * 3, [None] * 8 + [0] * 8),
])
def test_price_anomalies(spark, values, expect):
    got = labels.price_anomalies(series(spark, values)).orderBy("week").collect()
    assert [r.label for r in got] == expect
    assert {r.status for r in got if r.label is None} <= {"insufficient_data"}


def test_curated_expansion(spark):
    p = spark.createDataFrame([("a", dt.date(2024, 3, 1), dt.date(2024, 4, 30), 1, "up"), ("a", dt.date(2024, 4, 1), dt.date(2024, 5, 31), 0, "down")], "resource_id string, start_date date, end_date date, label int, justification string")
    rows = {r.week_start: r.label for r in labels.expand_periods(p, 8).collect()}
    assert min(rows) == dt.date(2024, 1, 1) and rows[dt.date(2024, 4, 29)] == 1 and rows[dt.date(2024, 5, 6)] == 0
    assert all(d.weekday() == 0 for d in rows)


def test_weekly_sum_absent_is_not_zero(spark):
    rows = [("d", "2026-01-05", 3.0), ("d", "2026-01-06", 5.0), ("d", "2026-01-13", 4.0), ("d", "2026-01-20", None)]
    w = W.weekly_sum(spark.createDataFrame(rows, "resource_id string, s string, v double").withColumn("ts", F.col("s").cast("timestamp")), "resource_id", "ts", "v")
    assert {str(r.week): r.y for r in w.collect()} == {"2026-01-05": 8.0, "2026-01-12": 4.0}


def frames(spark, future=False):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    prices = [("a", d, 100.0 + i) for i, d in enumerate(days)]
    signals = [("a", d, float(i % 10)) for i, d in enumerate(days) if i % 7 == 0] + [("a", days[3], None)]
    fc = [("a", "1m", days[30], 5.0, 4.0, 7.0, 3.0, "ok"), ("a", "1m", days[60], 6.0, 4.0, 9.0, 30.0, "unstable_disagreement")]
    if future:
        late = dt.datetime(2024, 8, 1)
        prices += [("a", late, 9999.0)]
        signals += [("a", late, 9.0)]
        fc += [("a", "1m", late, 1.0, 0.0, 2.0, 1.0, "ok")]
    return (
        spark.createDataFrame(prices, "resource_id string, ts timestamp, price_usd double"), spark.createDataFrame(signals, "resource_id string, ts timestamp, severity double"),
        spark.createDataFrame(fc, "resource_id string, horizon string, run_at timestamp, prophet_point double, prophet_lower double, prophet_upper double, disagreement_pct double, status string"),
        spark.createDataFrame([("a", 0.5), ("b", None)], "resource_id string, hhi_country double"))


def grid(spark):
    return W.spine(spark.createDataFrame([("a",), ("b",)], "resource_id string"), F.lit("2024-01-01").cast("date"), F.lit("2024-04-28").cast("date"))


def test_features_have_no_look_ahead(spark):
    now = features.feature_rows(grid(spark), *frames(spark)).orderBy("resource_id", "week").collect()
    later = features.feature_rows(grid(spark), *frames(spark, future=True)).orderBy("resource_id", "week").collect()
    assert now == later and len(now) == 34
    last = [r for r in now if r.resource_id == "a"][-1]
    assert last.forecast_unstable_flag == 1.0 and last.forecast_point_1m == 6.0 and last.signal_count_4w == 4.0 and last.price_trend_4w > 0
    b = [r for r in now if r.resource_id == "b"][-1]
    assert b.price_latest is None and b.signal_count_4w is None and b.hhi_country is None


def test_split(spark):
    rows = series(spark, range(100))
    out = features.chronological_split(rows).groupBy("part").agg(F.count("*").alias("n"), F.min("week").alias("lo"), F.max("week").alias("hi")).collect()
    by = {r.part: r for r in out}
    assert by["train"].n == 80 and by["test"].n == 20 and by["train"].hi <= by["test"].lo


def test_forecast_states(spark):
    w = series(spark, range(10, 40)).unionByName(series(spark, range(5), "short"))
    rows = forecast.forecast_rows(w, forecast.holt(w)).collect()
    a = [r for r in rows if r.resource_id == "a"]
    assert len(a) == 4 and all(r.prophet_lower <= r.prophet_point <= r.prophet_upper and r.status == "ok" for r in a)
    assert [(r.horizon, r.status) for r in rows if r.resource_id == "short"] == [("all", "insufficient_data")]
    assert abs(next(r.holt_winters_point for r in a if r.horizon == "2w") - 41) < 0.5


def test_metrics(spark):
    rows = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.8), ("m", 1, 0.8), ("m", 0, 0.1), ("one", 1, 0.7)], "model string, y int, p double")
    auc = {r.model: r for r in metrics.roc_auc(rows, ["model"]).collect()}
    assert auc["m"].roc_auc == 0.875 and auc["one"].roc_auc is None
    c = {r.model: r for r in metrics.classification(rows, ["model"]).collect()}
    assert (c["m"].tp, c["m"].fp, c["m"].fn, c["m"].tn) == (2, 1, 0, 1) and c["one"].precision == 1.0
    assert metrics.confusion(rows, ["model"]).count() == 8


def test_clusters_and_canonical(spark):
    v = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.98, 0.02, 0.0, 0.0]), (3, [0.97, 0.0, 0.03, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(v, "id long, e array<double>")
    c = cluster.clusters(rows, "id", "e").collect()
    assert sorted((r.id, r.component) for r in c) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    m = rows.join(cluster.clusters(rows, "id", "e"), "id").withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "url": F.lit(None).cast("string")})
    out = cluster.memberships(m, "component", "id", "ts", "url")
    assert out.where("is_canonical").count() == 3 and out.count() == 5


def test_resolver_layers(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return text.hashed_embedding(texts)

    aliases = spark.createDataFrame([("s", "Samsung"), ("m", "MU")], "producer_id string, term string")
    docs = spark.createDataFrame([(1, "Samsung builds"), (2, "Samsumg builds"), (3, "aluminum"), (4, None)], "id long, t string")
    out = {r.id: (r.producer_id, r.method) for r in text.resolve(docs, "id", "t", aliases).collect()}
    assert out[1] == ("s", "exact_alias") and out[3] == (None, "unresolved") and out[4] == (None, "unresolved")
    assert out[2][1] in ("fuzzy", "unresolved")
    text.resolve(docs.where("id = 1"), "id", "t", aliases, embed, {}).collect()
    assert seen.value == 0


def test_sinks_are_idempotent(spark):
    old = spark.createDataFrame([("u", None, 1)], "url string, r string, n int")
    batch = spark.createDataFrame([("u", None, 2), ("v", "x", 3), ("v", "x", 4)], "url string, r string, n int")
    once = sinks.append_absent(old, batch, ["url", "r"], ["n"])
    assert sorted(r.n for r in once.collect()) == [1, 3]
    assert sinks.differences(once, sinks.append_absent(once, batch, ["url", "r"], ["n"])).isEmpty()
    up = sinks.upsert(old, batch, ["url", "r"], ["n"])
    assert sorted(r.n for r in up.collect()) == [2, 4]
    assert sinks.differences(up, sinks.upsert(up, batch, ["url", "r"], ["n"])).isEmpty()
    assert sinks.above_watermark(old.where("n > 9"), batch, "n").count() == 3 and sinks.above_watermark(old, batch, "n").count() == 3


def test_readers(spark):
    raw = spark.createDataFrame([("2023-01-01", "DRAM", "A b", "usd_per_gb", "2.5", "", ""), ("1990-01-01", "DRAM", "x", "usd_per_gb", "2", "", ""), ("2100-01-01", "DRAM", "x", "usd_per_gb", "2", "", ""), ("2023-01-01", "GPU", "x", "usd_per_gb", "2", "", ""), ("2023-01-01", "NAND", "x", "share", "2", "", ""), ("2023-01-01", "NAND", "x", "usd_per_gb", "n/a", "", "")], readers.MEMORY_SCHEMA)
    assert [(r.resource_id, r.source) for r in readers.memory_prices(raw, F.lit("2024-01-01").cast("date")).collect()] == [("dram", "stanford_dam:a_b")]
    wide = spark.createDataFrame([("2024M11", "70", "…"), ("2024M12", "71", "3"), ("x", "1", "1")], "period string, oil string, gas string")
    got = readers.commodity_prices(wide, "period", {"oil": "($/bbl)"}, 2).collect()
    assert sorted((str(r.date), r.commodity_name, r.price, r.unit) for r in got) == [("2024-11-01", "oil", 70.0, "($/bbl)"), ("2024-12-01", "gas", 3.0, None), ("2024-12-01", "oil", 71.0, "($/bbl)")]


def test_alert_feed(spark):
    p = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0.5, 1)], "resource_id string, predicted_at timestamp, calibrated_probability double, id long")
    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 2), None, "ok", 1)], "resource_id string, generated_at timestamp, narrative string, status string, id long")
    r = spark.createDataFrame([("a", "A")], "resource_id string, name string")
    assert [x.kind for x in views.alert_feed(p, e, r).orderBy(F.desc("at")).collect()] == ["explanation", "prediction"]
    assert views.alert_feed(p, e, r, 1).count() == 1
