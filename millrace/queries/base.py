"""Stand-in tables, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import weekly as W
from millrace.session import table


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("resource_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("price_usd"))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return W.weekly_mean(prices(spark, d), "resource_id", "ts", "price_usd")


def signals(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(F.col("o_orderpriority").alias("resource_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("severity"), F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("part"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    o, p = table(spark, d, "orders"), F.col("o_totalprice")
    dis = F.pmod(F.col("o_custkey"), F.lit(50)).cast("double")
    return o.select(
        F.col("o_orderpriority").alias("resource_id"), F.lit("price_proxy").alias("series_type"), F.when(F.col("o_orderstatus") == "O", "1m").when(F.col("o_orderstatus") == "F", "2w").otherwise("3m").alias("horizon"),
        F.col("o_orderdate").cast("timestamp").alias("run_at"), p.alias("prophet_point"), (p * 0.5).alias("prophet_lower"), (p * 2).alias("prophet_upper"), (p + F.col("o_custkey")).alias("holt_winters_point"),
        dis.alias("disagreement_pct"), F.when(dis > 48, "unstable_disagreement").otherwise("ok").alias("status"), F.col("o_orderkey").alias("id"))


def resources(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_orderstatus").alias("n"))
    return o.select(F.col("o_orderpriority").alias("resource_id"), F.col("o_orderpriority").alias("name"), F.round(F.lit(1.0) / F.col("n"), 4).alias("hhi_country"))


PRICES = "prices AS (SELECT o_orderpriority AS resource_id, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS price_usd FROM orders)"
WEEKLY = PRICES + ", weekly AS (SELECT resource_id, CAST(date_trunc('week', ts) AS DATE) AS week, avg(price_usd) AS y FROM prices GROUP BY 1, 2)"
SIGNALS = "signals AS (SELECT o_orderpriority AS resource_id, CAST(l_shipdate AS TIMESTAMP) AS ts, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS severity, l_orderkey AS signal_id, l_linenumber AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
FORECASTS = """forecasts AS (SELECT o_orderpriority AS resource_id, 'price_proxy' AS series_type, CASE o_orderstatus WHEN 'O' THEN '1m' WHEN 'F' THEN '2w' ELSE '3m' END AS horizon,
  CAST(o_orderdate AS TIMESTAMP) AS run_at, o_totalprice AS prophet_point, o_totalprice * 0.5 AS prophet_lower, o_totalprice * 2 AS prophet_upper, o_totalprice + o_custkey AS holt_winters_point,
  CAST(o_custkey % 50 AS DOUBLE) AS disagreement_pct, CASE WHEN o_custkey % 50 > 48 THEN 'unstable_disagreement' ELSE 'ok' END AS status, o_orderkey AS id FROM orders)"""
RESOURCES = "resources AS (SELECT o_orderpriority AS resource_id, o_orderpriority AS name, round(1.0 / count(DISTINCT o_orderstatus), 4) AS hhi_country FROM orders GROUP BY 1)"
TRAILING = WEEKLY + """, t AS (SELECT *, row_number() OVER w - 1 AS i, avg(y) OVER b AS m, stddev_pop(y) OVER b AS sd, max(y) OVER b = min(y) OVER b AS flat, count(y) OVER b AS n,
  (y / nullif(lag(y, 4) OVER w, 0) - 1) * 100 AS trend FROM weekly WINDOW w AS (PARTITION BY resource_id ORDER BY week), b AS (PARTITION BY resource_id ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""
LABELS = TRAILING + """, z AS (SELECT *, CASE WHEN n = 8 THEN CASE WHEN flat THEN CASE WHEN y > m THEN 'infinity'::DOUBLE ELSE 0.0 END ELSE (y - m) / sd END END AS z FROM t),
e AS (SELECT *, coalesce(i >= 8 AND z > 2.0, false) AS elevated FROM z),
g AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY week) - row_number() OVER (PARTITION BY resource_id, elevated ORDER BY week) AS isl FROM e),
labels AS (SELECT resource_id, week, y, z, elevated, CASE WHEN elevated THEN count(*) OVER (PARTITION BY resource_id, elevated, isl) ELSE 0 END AS run, i FROM g),
price_labels AS (SELECT resource_id, week, y, z, CASE WHEN i >= 8 THEN CASE WHEN run >= 3 THEN 1 ELSE 0 END END AS label, CASE WHEN i >= 8 THEN 'ok' ELSE 'insufficient_data' END AS status, run FROM labels)"""
