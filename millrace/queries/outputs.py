"""Prompts, judgments, persistence, context views and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import prompts, times
from millrace.functions import text as X
from millrace.operators import cluster, dictionary, features, metrics, text, views
from millrace.queries import query, series, textual
from millrace.session import table

R = lambda c: F.round(c, 6)


def _text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CONTRACT = _text_sql(prompts._EXTRACTION)


@query(f"""SELECT doc_id, md5(concat_ws(chr(10), 'Below is a news text that may bear on the supply of or demand for ' || source || '.', 'Say what kind of event it reports and how severe that is for this resource.', '', 'Text:', coalesce(text, ''), '', {_CONTRACT})) AS prompt FROM documents""")
def x12_news_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(prompts.news(F.col("text"), F.col("source"))).alias("prompt"))


@query("""WITH e AS (SELECT l_orderkey, string_agg('- signal ' || l_linenumber || ' (' || CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE 'no address' END || '): ' || l_returnflag, chr(10) ORDER BY l_linenumber) AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey, md5(concat_ws(chr(10), 'Write a note on the supply of ' || o_orderpriority || '.', 'Use the evidence below and nothing else.', '', 'Evidence:', lines, CASE WHEN o_orderstatus <> 'P' THEN 'Model, for orientation: probability 0.2500' || CASE WHEN o_orderstatus = 'F' THEN '; drivers price_latest (+0.125), hhi_country (-0.500)' ELSE '' END END, '',
'Answer with one JSON object: "narrative" of at most 120 words, and "citations", a list of objects with "signal_id" (one of those above) and "excerpt" (at most 25 words of its text).')) AS prompt FROM orders JOIN e ON o_orderkey = l_orderkey""")
def x12_narration_prompt(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("mode"), F.min("l_returnflag").alias("flag"))
    e = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("signal_id"), F.when(F.pmod("l_linenumber", F.lit(2)) == 0, F.col("mode")).alias("source_url"), F.col("flag").alias("raw_text")))).alias("evidence"))  # lines of an order
    o = table(spark, d, "orders").join(e, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.col("o_orderstatus")
    drivers = F.when(status == "F", F.array(F.struct(F.lit("price_latest").alias("feature"), F.lit(0.125).alias("contribution")), F.struct(F.lit("hhi_country").alias("feature"), F.lit(-0.5).alias("contribution"))))
    return o.select("o_orderkey", F.md5(prompts.narration(F.col("o_orderpriority"), F.col("evidence"), F.when(status != "P", 0.25), drivers)).alias("prompt"))


_RAW = """a AS (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN '```json {"tightening_probability": 0.' || (user_id % 10) || ', "rationale": " r "} ```' WHEN 1 THEN '{"tightening_probability": 1.5}' WHEN 2 THEN '{"tightening_probability": "0.25"}' WHEN 3 THEN '{"tightening_probability": "high"}'
WHEN 4 THEN '{"other": 1}' WHEN 5 THEN 'no json' WHEN 6 THEN '{"tightening_probability": true}' END AS raw FROM events)"""


@query(f"""WITH {_RAW} SELECT event_id, CASE event_id % 8 WHEN 0 THEN (user_id % 10) / 10.0 WHEN 2 THEN 0.25 WHEN 6 THEN 1.0 END AS probability, CASE event_id % 8 WHEN 0 THEN 'r' WHEN 2 THEN '' WHEN 6 THEN '' END AS rationale,
CASE event_id % 8 WHEN 1 THEN 'probability_out_of_range' WHEN 3 THEN 'non_numeric_probability' WHEN 4 THEN 'unparseable_llm_output' WHEN 5 THEN 'unparseable_llm_output' WHEN 7 THEN 'llm_call_failed' END AS error FROM a""")
def k28_judgment(spark, d):
    k = F.pmod("event_id", F.lit(8))
    raw = (
        F.when(k == 0, F.concat(F.lit('```json {"tightening_probability": 0.'), F.pmod("user_id", F.lit(10)).cast("string"), F.lit(', "rationale": " r "} ```'))).when(k == 1, '{"tightening_probability": 1.5}')
        .when(k == 2, '{"tightening_probability": "0.25"}').when(k == 3, '{"tightening_probability": "high"}').when(k == 4, '{"other": 1}').when(k == 5, "no json").when(k == 6, '{"tightening_probability": true}'))
    v = text.validate_judgment(raw)
    return table(spark, d, "events").select("event_id", v["probability"].alias("probability"), v["rationale"].alias("rationale"), v["error"].alias("error"))


@query("""SELECT l_orderkey, l_linenumber, '{"order":' || l_orderkey || ',"flag":"' || l_returnflag || '","late":' || CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'null' END || '}' AS j FROM lineitem""")
def q6_to_json(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.to_json(order=F.col("l_orderkey"), flag=F.col("l_returnflag"), late=F.when(F.col("l_linestatus") == "F", F.lit(True))).alias("j"))


@query("SELECT o_orderkey FROM orders WHERE isodow(o_orderdate) <= 5")
def d8_weekdays(spark, d):
    return table(spark, d, "orders").where(times.is_weekday(F.col("o_orderdate").cast("timestamp"))).select("o_orderkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Explanation generated.' WHEN 'error' THEN 'No explanation has been generated for this resource yet.' ELSE '⚠ Unrecognized explanation status: ''' || event_type || '''' END AS sentence FROM events")
def x10_explanation_sentence(spark, d):
    s = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "error", "not_attempted").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", views.status_sentence(s, views.EXPLANATION_SENTENCES, "explanation").alias("sentence"))


@query("""SELECT c_custkey, coalesce((SELECT list_sort(list(DISTINCT o_orderpriority)) FROM orders WHERE o_custkey = c_custkey), [])::VARCHAR AS resources FROM customer""")
def j5_default_list(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("resources"))
    out = views.with_list(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "resources")
    return out.select("c_custkey", F.concat(F.lit("["), F.array_join("resources", ", "), F.lit("]")).alias("resources"))


@query("""WITH l AS (SELECT o_orderpriority AS resource_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderstatus AS j FROM orders), n(j, episode_name) AS (VALUES ('F', 'finished'), ('O', 'open'))
SELECT resource_id, episode_name, min(week) AS start_week, max(week) AS end_week FROM l LEFT JOIN n USING (j) GROUP BY resource_id, j, episode_name""")
def j19_historical_context(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderpriority").alias("resource_id"), times.week_start(F.col("o_orderdate").cast("timestamp")).alias("week_start"), F.lit(1).alias("label"), F.lit("curated_episode").alias("source"), F.col("o_orderstatus").alias("justification"))
    return views.historical_context(labels, spark.createDataFrame([("F", "finished"), ("O", "open")], "justification string, episode_name string"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey % 3 AS a, o_totalprice / 100000 AS z, CASE o_orderstatus WHEN 'O' THEN 'rising' WHEN 'F' THEN 'falling' END AS direction, o_orderpriority = '1-URGENT' AS known FROM orders),
s AS (SELECT *, coalesce(a = 1, false) OR coalesce(direction = 'rising', false) OR coalesce(z >= 2, false) AS present FROM b)
SELECT o_orderkey AS resource_id, CASE WHEN known THEN 'tightening' ELSE 'unknown' END AS expected_outcome, CASE WHEN present THEN 'tightening_signal_present' ELSE 'no_tightening_signal' END AS observed_signal, present AND known AS direction_match FROM s""")
def k30_outcome(spark, d):
    o = table(spark, d, "orders").withColumn("cutoff", F.col("o_orderdate").cast("date"))
    key = F.col("o_orderkey").alias("resource_id")
    bundle = o.select(key, "cutoff", F.pmod("o_custkey", F.lit(3)).alias("anomaly_label_latest"), (F.col("o_totalprice") / 100000).alias("price_zscore_latest"))
    direction = o.where("o_orderstatus in ('O', 'F')").select(key, "cutoff", F.when(F.col("o_orderstatus") == "O", "rising").otherwise("falling").alias("direction"))
    episodes = o.where("o_orderpriority = '1-URGENT'").select(key)
    return features.compare_outcome(bundle, direction, episodes).select("resource_id", "expected_outcome", "observed_signal", "direction_match")


@query("WITH c AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS clusters, count(*) AS canonical, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM c")
def g13_summary(spark, d):
    return cluster.summary(textual.k21_memberships(spark, d))


@query(f"WITH {series._ATTR} SELECT feature, importance FROM (SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM u GROUP BY 1) WHERE importance > 0.055 ORDER BY importance DESC LIMIT 6")
def o5_top_importances(spark, d):
    return metrics.top_importances(metrics.importance(series._attributions(spark, d)).withColumn("importance", R("importance")), 6, 0.055)


@query("""SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [s_name, 'supplier ' || s_suppkey] ELSE [s_name] END) AS term, CAST(s_nationkey AS BIGINT) AS position FROM supplier""")
def q9_exploded_catalogue(spark, d):
    other = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.array(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.col("s_name"), F.lit(" ")))
    s = table(spark, d, "supplier").withColumn("aliases", other)
    return dictionary.exploded(s, "s_suppkey", "s_name", "aliases", "s_nationkey").withColumn("position", F.col("position").cast("long"))


@query("SELECT DISTINCT o_orderpriority AS resource_id, o_orderpriority AS name FROM orders ORDER BY 1")
def v1_all_resources(spark, d):
    from millrace.queries import base

    return views.all_resources(base.resources(spark, d))
