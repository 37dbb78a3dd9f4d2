"""Weekly series, labels, features, forecasts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import times
from millrace.functions import vectors as V
from millrace.operators import attribution, features, forecast, labels, metrics
from millrace.operators import weekly as W
from millrace.queries import base as B
from millrace.queries import query
from millrace.schemas import HORIZONS
from millrace.session import table

R = lambda c: F.round(c, 6)


@query(f"WITH {B.WEEKLY} SELECT resource_id, week, round(y, 6) AS y FROM weekly")
def k1_weekly_price(spark, d):
    return B.weekly(spark, d).select("resource_id", "week", R("y").alias("y"))


@query(f"WITH {B.SIGNALS} SELECT resource_id, CAST(date_trunc('week', ts) AS DATE) AS week, round(sum(severity), 6) AS y FROM signals WHERE severity IS NOT NULL GROUP BY 1, 2")
def k2_weekly_demand(spark, d):
    return W.weekly_sum(B.signals(spark, d), "resource_id", "ts", "severity").select("resource_id", "week", R("y").alias("y"))


@query(f"WITH {B.TRAILING} SELECT resource_id, week, round(trend, 6) AS trend FROM t")
def w1_lag_change(spark, d):
    return W.trailing(B.weekly(spark, d), "resource_id").select("resource_id", "week", R("trend").alias("trend"))


@query(f"WITH {B.TRAILING} SELECT resource_id, week, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, round(m, 6) AS mean, CASE WHEN n = 8 AND NOT flat THEN round((y - m) / sd, 6) END AS z FROM t")
def w2_trailing_z(spark, d):
    t = W.trailing(B.weekly(spark, d), "resource_id")
    return t.select("resource_id", "week", F.col("i").cast("long").alias("i"), "n", R("mean").alias("mean"), R(W.zscore()).alias("z"))


@query(f"WITH {B.LABELS} SELECT resource_id, week, elevated, CAST(run AS BIGINT) AS run FROM labels")
def w4_runs(spark, d):
    t = W.trailing(B.weekly(spark, d), "resource_id").withColumn("elevated", F.coalesce((F.col("i") >= 8) & (W.zscore("inf") > 2.0), F.lit(False)))
    return W.runs(t, "resource_id", "week", "elevated").select("resource_id", "week", "elevated", F.col("run").cast("long").alias("run"))


@query(f"WITH {B.LABELS} SELECT resource_id, week, round(z, 6) AS z, CAST(label AS INT) AS label, status FROM price_labels")
def k8_price_labels(spark, d):
    return labels.price_anomalies(B.weekly(spark, d)).select("resource_id", "week", R("z").alias("z"), "label", "status")


_PERIODS = """periods AS (SELECT o_orderpriority AS resource_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INT) AS end_date, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label, 'order ' || o_orderkey AS justification FROM orders WHERE o_totalprice > 400000)"""
_CURATED = _PERIODS + """, x AS (SELECT *, CAST(unnest(generate_series(CAST(date_trunc('week', start_date - CASE WHEN label = 1 THEN 56 ELSE 0 END) AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start FROM periods),
r AS (SELECT *, row_number() OVER (PARTITION BY resource_id, week_start ORDER BY label DESC, start_date, justification) AS r FROM x),
curated AS (SELECT resource_id, week_start, CAST(label AS INT) AS label, 'curated_episode' AS source, 'ok' AS status, justification FROM r WHERE r = 1)"""


def _periods(spark, d):
    o, day = table(spark, d, "orders").where("o_totalprice > 400000"), F.to_date("o_orderdate")
    return o.select(F.col("o_orderpriority").alias("resource_id"), day.alias("start_date"), F.date_add(day, F.pmod(F.col("o_custkey"), F.lit(90)).cast("int")).alias("end_date"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("label"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("justification"))


@query(f"WITH {_CURATED} SELECT * FROM curated")
def k7_curated_labels(spark, d):
    return labels.expand_periods(_periods(spark, d), lead_weeks=8)


_BOTH = f"{_CURATED}, {B.LABELS}, both_l AS (SELECT resource_id, week_start, label, source, status FROM curated UNION ALL SELECT resource_id, week, CAST(label AS INT), 'price_derived', status FROM price_labels)"


def _both(spark, d):
    p = labels.price_anomalies(B.weekly(spark, d)).select("resource_id", F.col("week").alias("week_start"), "label", F.lit("price_derived").alias("source"), "status")
    return k7_curated_labels(spark, d).drop("justification").unionByName(p)


@query(f"WITH {_BOTH} SELECT c.resource_id, c.week_start, c.source, c.label, p.source AS other_source, p.label AS other_label FROM both_l c JOIN both_l p ON c.resource_id = p.resource_id AND c.week_start = p.week_start AND c.source < p.source AND c.label <> p.label WHERE c.status = 'ok' AND p.status = 'ok'")
def k9_disagreement(spark, d):
    return labels.disagreements(_both(spark, d))


@query(f"WITH {_BOTH} SELECT resource_id, count(*) AS n FROM curated c WHERE NOT EXISTS (SELECT 1 FROM weekly w WHERE w.resource_id = c.resource_id AND w.week = c.week_start) GROUP BY 1")
def j12_uncovered_weeks(spark, d):
    return labels.uncovered(k7_curated_labels(spark, d), B.weekly(spark, d))


_PREFER = f"{_BOTH}, pref AS (SELECT *, row_number() OVER (PARTITION BY resource_id, week_start ORDER BY CASE source WHEN 'curated_episode' THEN 1 ELSE 2 END) AS r FROM both_l)"


@query(f"WITH {_PREFER} SELECT resource_id, week_start, label, source, status FROM pref WHERE r = 1")
def w7_source_priority(spark, d):
    return labels.prefer_source(_both(spark, d))


_GRID = "grid AS (SELECT resource_id, CAST(unnest(generate_series(date_trunc('week', min(ts)), max(ts), INTERVAL 7 DAY)) AS DATE) AS week FROM prices GROUP BY resource_id)"


def _grid(spark, d):
    ends = B.prices(spark, d).groupBy("resource_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return W.spine(ends, F.col("a"), F.col("z")).select("resource_id", "week")


@query(f"WITH {B.PRICES}, {_GRID} SELECT * FROM grid")
def j17_week_spine(spark, d):
    return _grid(spark, d)


_ASOF = f"""{B.TRAILING}, {_GRID}, pf AS (SELECT resource_id, week, y AS price_latest, trend AS price_trend_4w, CASE WHEN n = 8 AND NOT flat THEN (y - m) / sd END AS price_zscore_8w FROM t),
af AS (SELECT g.resource_id, g.week, p.price_latest, p.price_trend_4w, p.price_zscore_8w FROM grid g ASOF LEFT JOIN pf p ON g.resource_id = p.resource_id AND g.week >= p.week)"""


@query(f"WITH {_ASOF} SELECT resource_id, week, round(price_latest, 6) AS price_latest, round(price_trend_4w, 6) AS price_trend_4w, round(price_zscore_8w, 6) AS price_zscore_8w FROM af")
def j14_asof_price(spark, d):
    cols = ["price_latest", "price_trend_4w", "price_zscore_8w"]
    out = W.asof_fill(_grid(spark, d), features.price_features(B.prices(spark, d)), "resource_id", cols)
    return out.select("resource_id", "week", *(R(c).alias(c) for c in cols))


_SIG = f"""sg AS (SELECT g.resource_id, g.week, sum(s.severity) / count(s.severity) AS signal_severity_mean_4w, count(s.severity) AS c FROM grid g LEFT JOIN signals s ON s.resource_id = g.resource_id AND s.severity IS NOT NULL
  AND CAST(s.ts AS DATE) > g.week + 6 - 28 AND CAST(s.ts AS DATE) <= g.week + 6 GROUP BY 1, 2),
fs AS (SELECT resource_id, CAST(date_trunc('week', min(ts)) AS DATE) AS f FROM signals WHERE severity IS NOT NULL GROUP BY 1),
sf AS (SELECT sg.resource_id, sg.week, signal_severity_mean_4w, CASE WHEN f <= sg.week THEN CAST(c AS DOUBLE) END AS signal_count_4w FROM sg LEFT JOIN fs USING (resource_id))"""


@query(f"WITH {B.PRICES}, {_GRID}, {B.SIGNALS}, {_SIG} SELECT resource_id, week, round(signal_severity_mean_4w, 6) AS signal_severity_mean_4w, signal_count_4w FROM sf")
def j15_signal_window(spark, d):
    out = features.signal_features(_grid(spark, d), B.signals(spark, d))
    return out.select("resource_id", "week", R("signal_severity_mean_4w").alias("signal_severity_mean_4w"), "signal_count_4w")


_FC = """fw AS (SELECT resource_id, CAST(date_trunc('week', run_at) AS DATE) AS week,
  max_by(prophet_point, (run_at, prophet_point)) FILTER (horizon = '1m') AS p, max_by(prophet_upper - prophet_lower, (run_at, prophet_upper - prophet_lower)) FILTER (horizon = '1m') AS w, max_by(disagreement_pct, (run_at, disagreement_pct)) FILTER (horizon = '1m') AS d,
  max(CASE WHEN status = 'unstable_disagreement' THEN 1 ELSE 0 END) AS u, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS o FROM forecasts GROUP BY 1, 2),
fj AS (SELECT coalesce(g.resource_id, f.resource_id) AS resource_id, coalesce(g.week, f.week) AS week, p, w, d, u, o FROM grid g FULL JOIN fw f ON g.resource_id = f.resource_id AND g.week = f.week),
ff AS (SELECT resource_id, week, last_value(p IGNORE NULLS) OVER b AS forecast_point_1m, last_value(w IGNORE NULLS) OVER b AS forecast_interval_width_1m, last_value(d IGNORE NULLS) OVER b AS forecast_disagreement_1m,
  CASE WHEN max(u) OVER b = 1 THEN 1.0::DOUBLE WHEN max(o) OVER b = 1 THEN 0.0::DOUBLE END AS forecast_unstable_flag FROM fj WINDOW b AS (PARTITION BY resource_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {B.PRICES}, {_GRID}, {B.FORECASTS}, {_FC} SELECT g.resource_id, g.week, round(forecast_point_1m, 6) AS forecast_point_1m, round(forecast_interval_width_1m, 6) AS forecast_interval_width_1m, forecast_disagreement_1m, forecast_unstable_flag FROM grid g LEFT JOIN ff USING (resource_id, week)")
def j16_asof_forecast(spark, d):
    out = features.forecast_features(_grid(spark, d), B.forecasts(spark, d))
    return out.select("resource_id", "week", R("forecast_point_1m").alias("forecast_point_1m"), R("forecast_interval_width_1m").alias("forecast_interval_width_1m"), "forecast_disagreement_1m", "forecast_unstable_flag")


_FEATURES = f"""{_ASOF}, {B.SIGNALS}, {_SIG}, {B.FORECASTS}, {_FC}, {B.RESOURCES},
feat AS (SELECT a.resource_id, a.week, round(price_latest, 6) AS price_latest, round(price_trend_4w, 6) AS price_trend_4w, round(price_zscore_8w, 6) AS price_zscore_8w, round(forecast_point_1m, 6) AS forecast_point_1m,
  round(forecast_interval_width_1m, 6) AS forecast_interval_width_1m, forecast_disagreement_1m, forecast_unstable_flag, round(signal_severity_mean_4w, 6) AS signal_severity_mean_4w, signal_count_4w, hhi_country
  FROM af a LEFT JOIN sf USING (resource_id, week) LEFT JOIN ff USING (resource_id, week) LEFT JOIN resources USING (resource_id))"""


def _features(spark, d):
    out = features.feature_rows(_grid(spark, d), B.prices(spark, d), B.signals(spark, d), B.forecasts(spark, d), B.resources(spark, d))
    rounded = ("price_latest", "price_trend_4w", "price_zscore_8w", "forecast_point_1m", "forecast_interval_width_1m", "signal_severity_mean_4w")
    return out.withColumns({c: R(c) for c in rounded})


@query(f"WITH {_FEATURES} SELECT * FROM feat")
def k10_features(spark, d):
    return _features(spark, d)


_TRAIN = f"{_FEATURES}, e2 AS (SELECT *, 1 AS one FROM t), {_CURATED.replace('r AS (', 'rr AS (').replace('FROM r WHERE', 'FROM rr WHERE')}, train AS (SELECT f.*, c.label, c.source AS label_source FROM curated c JOIN feat f ON f.resource_id = c.resource_id AND f.week = c.week_start WHERE price_latest IS NOT NULL)"


@query(f"WITH {_TRAIN} SELECT resource_id, week, label, label_source, price_latest, signal_count_4w FROM train")
def k11_training_table(spark, d):
    return features.training_table(k7_curated_labels(spark, d), _features(spark, d)).select("resource_id", "week", "label", "label_source", "price_latest", "signal_count_4w")


@query(f"WITH {B.WEEKLY}, o AS (SELECT resource_id, week, row_number() OVER (ORDER BY week, resource_id) AS r, count(*) OVER () AS n FROM weekly) SELECT resource_id, week, CASE WHEN r <= floor(round(n * 0.8, 9)) THEN 'train' ELSE 'test' END AS part FROM o")
def w10_chronological_split(spark, d):
    return features.chronological_split(B.weekly(spark, d)).select("resource_id", "week", "part")


@query(f"""WITH {B.PRICES}, {B.SIGNALS}, cut AS (SELECT DISTINCT resource_id, TIMESTAMP '1998-06-30 00:00:00' AS cutoff FROM prices),
p AS (SELECT p.* FROM prices p JOIN cut USING (resource_id) WHERE ts <= cutoff), s AS (SELECT s.* FROM signals s JOIN cut USING (resource_id) WHERE ts <= cutoff),
w AS (SELECT resource_id, date_trunc('week', ts) AS week, avg(price_usd) AS y FROM p GROUP BY 1, 2)
SELECT c.resource_id, (SELECT count(*) FROM w WHERE w.resource_id = c.resource_id) AS n_price_points, (SELECT round(max_by(y, week), 6) FROM w WHERE w.resource_id = c.resource_id) AS latest_price,
(SELECT CAST(max(ts) AS DATE) FROM p WHERE p.resource_id = c.resource_id) AS latest_price_date, (SELECT count(*) FROM s WHERE s.resource_id = c.resource_id) AS n_signals,
(SELECT count(severity) FROM s WHERE s.resource_id = c.resource_id) AS n_scored_signals, (SELECT round(avg(severity), 6) FROM s WHERE s.resource_id = c.resource_id) AS mean_severity FROM cut c""")
def k29_asof_bundle(spark, d):
    p = B.prices(spark, d)
    cut = p.select("resource_id").distinct().withColumn("cutoff", F.lit("1998-06-30").cast("timestamp"))
    return features.asof_bundle(p, B.signals(spark, d), cut).select("resource_id", "n_price_points", "latest_price", "latest_price_date", "n_signals", "n_scored_signals", "mean_severity")


_LINE = f"""{B.WEEKLY}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY resource_id ORDER BY week) - 1 AS DOUBLE) AS x FROM weekly),
l AS (SELECT resource_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, count(y) AS n FROM x GROUP BY 1),
h(horizon, weeks) AS (VALUES ('2w', 2), ('1m', 4), ('3m', 13), ('6m', 26)),
line AS (SELECT resource_id, horizon, n, a + b * (n - 1 + weeks) AS point, sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2)) AS s FROM l, h)"""


@query(f"WITH {_LINE} SELECT resource_id, horizon, n, round(point, 4) AS point, round(point - 1.2815515655446004 * s, 4) AS lower, round(point + 1.2815515655446004 * s, 4) AS upper FROM line")
def k3_trend_forecast(spark, d):
    t = forecast.trend(B.weekly(spark, d))
    return t.select("resource_id", "horizon", "n", *(F.round(c, 4).alias(c) for c in ("point", "lower", "upper")))


@query()
def k4_holt(spark, d):
    return forecast.holt(B.weekly(spark, d))


@query()
def k3_changepoint_forecast(spark, d):
    t = forecast.changepoint_trend(B.weekly(spark, d))
    return t.select("resource_id", "horizon", "n", *(F.round(c, 4).alias(c) for c in ("point", "lower", "upper")))


@query()
def k6_forecast_rows(spark, d):
    w = B.weekly(spark, d)
    return forecast.forecast_rows(w, forecast.holt(w), first=forecast.changepoint_trend)


@query(f"""WITH {_LINE}, flat AS (SELECT resource_id, max_by(y, week) AS last FROM weekly GROUP BY 1), d AS (SELECT l.resource_id, l.horizon, n, point, last, point - 1.2815515655446004 * s AS lower, point + 1.2815515655446004 * s AS upper,
round(abs(point - last) / greatest(abs(point), abs(last), 1e-9) * 100, 2) AS dis FROM line l JOIN flat USING (resource_id))
SELECT resource_id, CASE WHEN n < 12 THEN 'all' ELSE horizon END AS horizon, CASE WHEN n >= 12 THEN round(point, 4) END AS prophet_point, CASE WHEN n >= 12 THEN round(last, 4) END AS holt_winters_point, CASE WHEN n >= 12 THEN dis END AS disagreement_pct,
CASE WHEN n < 12 THEN 'insufficient_data' WHEN dis > 25 THEN 'unstable_disagreement' ELSE 'ok' END AS status FROM d WHERE n >= 12 OR horizon = '2w'""")
def k6_status_rows(spark, d):
    """The status machine over the straight line, and the last price as the second model."""
    w = B.weekly(spark, d)
    last = w.groupBy("resource_id").agg(F.max_by("y", "week").alias("holt_winters_point")).withColumn("h", F.explode(forecast.horizons())).select("resource_id", "h.horizon", "holt_winters_point")
    r4 = lambda c: F.round(c, 4).alias(c)
    return forecast.forecast_rows(w, last).select("resource_id", "horizon", r4("prophet_point"), r4("holt_winters_point"), "disagreement_pct", "status")


@query(f"WITH {B.WEEKLY} SELECT resource_id, week, CASE WHEN row_number() OVER (PARTITION BY resource_id ORDER BY week DESC) <= 8 THEN 'test' ELSE 'train' END AS part FROM weekly")
def w11_holdout(spark, d):
    return forecast.holdout(B.weekly(spark, d)).select("resource_id", "week", "part")


@query(f"""WITH {B.WEEKLY}, p AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY week DESC) AS r FROM weekly), l AS (SELECT resource_id, max_by(y, week) AS predicted FROM p WHERE r > 8 GROUP BY 1),
e AS (SELECT p.resource_id, avg(abs(predicted - y)) AS mae, avg(abs(predicted - y) / abs(y)) * 100 AS mape FROM p JOIN l USING (resource_id) WHERE r <= 8 GROUP BY 1) SELECT 'naive' AS model, round(avg(mae), 6) AS mae, round(avg(mape), 6) AS mape, count(*) AS groups FROM e""")
def k31_forecast_bench(spark, d):
    h = forecast.holdout(B.weekly(spark, d))
    last = h.where("part = 'train'").groupBy("resource_id").agg(F.max_by("y", "week").alias("predicted"))
    e = metrics.forecast_errors(h.where("part = 'test'").join(last, "resource_id").select("resource_id", F.lit("naive").alias("model"), F.col("y").alias("actual"), "predicted"), "resource_id")
    return e.select("model", R("mae").alias("mae"), R("mape").alias("mape"), "groups")


@query()
def k31_trend_bench(spark, d):
    """Hold-out errors of the trends, Holt's and the last price at the horizons that the hold-out reaches."""
    h = forecast.holdout(B.weekly(spark, d))
    train = h.where("part = 'train'").drop("part")
    ends = train.groupBy("resource_id").agg(F.max("week").alias("end"), F.max_by("y", "week").alias("naive"))
    test = h.where("part = 'test'").join(ends, "resource_id").select("resource_id", F.round(F.datediff("week", "end") / 7).cast("int").alias("weeks"), F.col("y").alias("actual"), "naive")
    points = forecast.trend(train).select("resource_id", "horizon", F.lit("line").alias("model"), "point")
    points = points.unionByName(forecast.changepoint_trend(train).select("resource_id", "horizon", F.lit("changepoints").alias("model"), "point"))
    points = points.unionByName(forecast.holt(train).select("resource_id", "horizon", F.lit("holt").alias("model"), F.col("holt_winters_point").alias("point")))
    weeks = F.element_at(F.create_map(*(F.lit(x) for kv in HORIZONS.items() for x in kv)), F.col("horizon"))
    met = points.withColumn("weeks", weeks).join(test, ["resource_id", "weeks"]).select("resource_id", "model", "actual", F.col("point").alias("predicted"))
    met = met.unionByName(test.where(F.col("weeks").isin(*HORIZONS.values())).select("resource_id", F.lit("naive").alias("model"), "actual", F.col("naive").alias("predicted")))
    return metrics.forecast_errors(met, "resource_id").select("model", R("mae").alias("mae"), R("mape").alias("mape"), "groups")


_SCORES = "s AS (SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, (l_quantity + 1) / 64 AS p FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y"), ((F.col("l_quantity") + 1) / 64).alias("p"))


@query(f"""WITH {_SCORES}, c AS (SELECT model, count(*) AS n, sum(y)::BIGINT AS positives, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN p < 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, avg((p - y) * (p - y)) AS brier FROM s GROUP BY 1)
SELECT model, n, positives, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(brier, 6) AS brier FROM c""")
def g17_classification(spark, d):
    m = metrics.classification(_scores(spark, d), ["model"])
    return m.select("model", "n", "positives", "tp", "fp", "fn", "tn", *(R(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "brier")))


@query(f"""WITH {_SCORES}, g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS pp, sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, round(sum(pos * (nn - fp + neg / 2)) / nullif(max(pp) * max(nn), 0), 6) AS roc_auc, CASE WHEN max(pp) > 0 THEN round(sum(pos / nullif(pp, 0) * tp / (tp + fp)), 6) END AS pr_auc FROM c GROUP BY 1""")
def g18_auc(spark, d):
    return metrics.roc_auc(_scores(spark, d), ["model"]).select("model", R("roc_auc").alias("roc_auc"), R("pr_auc").alias("pr_auc"))


@query(f"""WITH {_SCORES}, g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS pp, sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, p AS threshold, round(tp / nullif(pp, 0), 6) AS tpr, round(fp / nullif(nn, 0), 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM c""")
def g20_curve_points(spark, d):
    return metrics.curve_points(_scores(spark, d), ["model"]).select("model", "threshold", *(R(c).alias(c) for c in ("tpr", "fpr", "precision")))


@query(f"WITH {_SCORES}, cells(y, predicted) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), m AS (SELECT DISTINCT model FROM s), c AS (SELECT model, y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT m.model, cells.y, cells.predicted, coalesce(n, 0)::BIGINT AS n FROM m CROSS JOIN cells LEFT JOIN c ON c.model = m.model AND c.y = cells.y AND c.predicted = cells.predicted")
def g20_confusion(spark, d):
    return metrics.confusion(_scores(spark, d), ["model"])


@query(f"WITH {_SCORES} SELECT model, CAST(least(floor(p * 5), 4) AS INT) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, count(*) AS n FROM s GROUP BY 1, 2")
def g22_reliability(spark, d):
    return metrics.reliability(_scores(spark, d), ["model"]).select("model", "bin", R("mean_p").alias("mean_p"), R("rate").alias("rate"), "n")


_ATTR = "a AS (SELECT l_orderkey, l_linenumber, 0.5 * (l_quantity - avg(l_quantity) OVER ()) AS q, -2.0 * (l_discount - avg(l_discount) OVER ()) AS dd, 3.0 * (l_tax - avg(l_tax) OVER ()) AS t FROM lineitem), u AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, q AS contribution FROM a UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', dd FROM a UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', t FROM a)"


_WEIGHTS = {"l_quantity": 0.5, "l_discount": -2.0, "l_tax": 3.0}


def _attributions(spark, d):
    return metrics.linear_attribution(table(spark, d, "lineitem"), _WEIGHTS, ["l_orderkey", "l_linenumber"])


@query(f"WITH {_ATTR} SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM u GROUP BY 1")
def g10_importance(spark, d):
    return metrics.importance(_attributions(spark, d)).select("feature", R("importance").alias("importance"))


@query(f"WITH {_ATTR}, s AS (SELECT l_orderkey, feature, CAST(round(sum(CAST(contribution AS DECIMAL(20, 10))), 6) AS DOUBLE) AS contribution FROM u GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(contribution) DESC, feature) AS INT) AS rank FROM s) SELECT l_orderkey, feature, contribution, rank FROM r WHERE rank <= 2")
def w13_top_drivers(spark, d):
    rows, names = table(spark, d, "lineitem"), list(_WEIGHTS)
    parts = metrics.contributions(_WEIGHTS, metrics.exact_means(rows, names))
    # Sums of whole ten-billionths don't depend on the order of rows; six places of them, halves away from zero.
    sums = rows.groupBy("l_orderkey").agg(*(F.sum(F.round(p * 1e10).cast("long")).alias(c) for c, p in parts.items()))
    six = [(F.signum(c) * F.floor((F.abs(c) + 5000) / 10_000) / 1e6).alias(c) for c in names]
    top = attribution.drivers(F.array(*names), names, 2)
    return sums.select("l_orderkey", *six).select("l_orderkey", F.posexplode(top).alias("i", "t")).select("l_orderkey", "t.feature", "t.contribution", (F.col("i") + 1).alias("rank"))


@query("SELECT o_orderpriority AS resource_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 6) AS median FROM orders GROUP BY 1")
def w14_median(spark, d):
    return B.prices(spark, d).groupBy("resource_id").agg(R(F.percentile("price_usd", 0.5)).alias("median"))


@query(f"WITH {B.FORECASTS} SELECT id, round(abs(prophet_point - holt_winters_point) / greatest(abs(prophet_point), abs(holt_winters_point), 1e-9) * 100, 6) AS disagreement FROM forecasts")
def m5_disagreement(spark, d):
    return B.forecasts(spark, d).select("id", R(V.disagreement(F.col("prophet_point"), F.col("holt_winters_point"))).alias("disagreement"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 150000) / 50000)), 6) AS p FROM orders")
def m6_sigmoid(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R(V.sigmoid((F.col("o_totalprice") - 150000) / 50000)).alias("p"))


@query(f"WITH {B.PRICES} SELECT count(*) AS n, CAST(max(ts) AS DATE) AS last_day FROM prices")
def g16_timeline_end(spark, d):
    return B.prices(spark, d).agg(F.count("*").alias("n"), F.to_date(F.max("ts")).alias("last_day"))


@query("SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS sunday, CAST(o_orderdate AS DATE) - 28 AS back FROM orders")
def d2_weeks(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", times.week_start(day).alias("week"), times.week_end(day).alias("sunday"), F.date_sub(F.to_date(day), 28).alias("back"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%dT120000Z') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT06:30:00') ELSE 'not-a-date' END AS s, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR WHEN 1 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) WHEN 2 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) WHEN 3 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) + INTERVAL 390 MINUTE END AS ts FROM s""")
def d1_parse_stamps(spark, d):
    k, day = F.pmod(F.col("o_orderkey"), F.lit(5)), F.col("o_orderdate").cast("timestamp")
    f = lambda p: F.date_format(day, p)
    s = F.when(k == 0, F.concat(f("yyyyMMdd"), F.lit("T120000Z"))).when(k == 1, f("yyyyMMdd")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, F.concat(f("yyyy-MM-dd"), F.lit("T06:30:00"))).otherwise("not-a-date")
    return table(spark, d, "orders").select("o_orderkey", times.parse_ts(s).alias("ts"))


@query("SELECT r_name, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01' + INTERVAL 1 MONTH * r_regionkey, INTERVAL 1 MONTH)) AS DATE) AS month_from FROM region")
def a16_month_windows(spark, d):
    first = F.lit("2024-01-15").cast("date")
    r = table(spark, d, "region").withColumn("w", F.explode(times.month_windows(first, F.add_months(first, F.col("r_regionkey")))))
    return r.select("r_name", F.col("w.from").alias("month_from"))


@query("SELECT p_partkey, CASE WHEN p_size <= 12 AND p_size > 0 THEN make_date(2000 + p_partkey % 20, p_size, 1) END AS d FROM part")
def d7_period(spark, d):
    return table(spark, d, "part").select("p_partkey", times.period_to_date(F.format_string("%dM%02d", 2000 + F.pmod(F.col("p_partkey"), F.lit(20)), F.col("p_size"))).alias("d"))


@query("SELECT event_type, n, day FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w16_cumulative(spark, d):
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_type", F.to_date(ts).alias("day"), F.unix_micros(ts).alias("at"), F.lit(1).alias("one"))
    x = metrics.running(metrics.in_ranges(e, ["event_type"], "at"), ["event_type"], [F.col("at")], {"n": "one"})
    return x.groupBy("event_type", "day").agg(F.max("n").alias("n")).select("event_type", "n", "day")
