"""Filters, joins, aggregates, windows, set operations, sinks and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import views
from millrace.operators.forecast import collapse_status
from millrace.queries import base as B
from millrace.queries import query
from millrace.schemas import RISK_TIERS, STATUS_PRIORITY
from millrace.session import table
from millrace.sources import readers, sinks

R = lambda c: F.round(c, 6)


# Scans and sources


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 300000")
def a1_scan(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a3_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_custkey, greatest(1, least(90, CAST(o_custkey AS BIGINT))) AS days, o_orderkey FROM orders")
def a4_clamp(spark, d):
    return table(spark, d, "orders").select("o_custkey", readers.clamp_lookback(F.col("o_custkey")).alias("days"), "o_orderkey")


def _bars(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.lit(float("nan")))).alias("close"), F.when(F.col("o_orderpriority") == "1-URGENT", "EUR").when(F.col("o_orderpriority") == "2-HIGH", "USD").alias("currency"))


_BARS = "bars AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice WHEN o_custkey % 2 = 0 THEN 'nan'::DOUBLE END AS close, CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'USD' END AS currency FROM orders)"


@query(f"WITH {_BARS} SELECT id, date, close FROM bars WHERE (currency IS NULL OR currency = 'USD') AND close IS NOT NULL AND NOT isnan(close)")
def a6_clean_closes(spark, d):
    return readers.clean_closes(_bars(spark, d)).select("id", "date", "close")


@query(f"WITH {_BARS} SELECT id, date, close FROM bars WHERE (currency IS NULL OR currency = 'USD') AND close IS NOT NULL AND NOT isnan(close) AND date >= DATE '1996-01-01' AND date < DATE '1997-01-01'")
def a5_closes_between(spark, d):
    day = lambda s: F.lit(s).cast("date")
    return readers.closes_between(_bars(spark, d), day("1996-01-01"), day("1997-01-01")).select("id", "date", "close")


@query("""SELECT strftime(o_orderdate + INTERVAL 24 YEAR, '%Y-%m-%d') AS date, CASE o_orderstatus WHEN 'O' THEN 'dram' ELSE 'nand' END AS resource_id, o_totalprice AS price_usd, 'USD_per_GB' AS unit,
'stanford_dam:' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '_', 'g'), '_') AS source, o_orderpriority AS series
FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey % 3 <> 0 AND year(o_orderdate + INTERVAL 24 YEAR) >= 2021 AND o_orderdate + INTERVAL 24 YEAR < TIMESTAMP '2024-01-02'""")
def a7_memory_prices(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(
        F.date_format(F.add_months(F.to_date("o_orderdate"), 288), "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "O", "DRAM").when(F.col("o_orderstatus") == "F", "NAND").otherwise("SSD").alias("category"), F.col("o_orderpriority").alias("series"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, "percent_share").otherwise("usd_per_gb").alias("metric"), F.col("o_totalprice").cast("string").alias("value"), F.lit("x").alias("unit"), F.lit("y").alias("source"))
    return readers.memory_prices(raw, F.lit("2024-01-01").cast("date"))


@query("""WITH w AS (SELECT strftime(o_orderdate, '%YM%m') AS period, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f FROM orders GROUP BY 1),
r AS (SELECT *, dense_rank() OVER (ORDER BY period DESC) AS k FROM w), u AS (SELECT period, 'oil' AS commodity_name, o AS price, '($/bbl)' AS unit FROM r WHERE k <= 6 UNION ALL SELECT period, 'gas', f, '($/mmbtu)' FROM r WHERE k <= 6)
SELECT make_date(CAST(left(period, 4) AS INT), CAST(right(period, 2) AS INT), 1) AS date, commodity_name, price, unit FROM u WHERE price IS NOT NULL""")
def a8_unpivot_prices(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy'M'MM").alias("period")).agg(*(F.coalesce(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).cast("string"), F.lit("…")).alias(n) for s, n in (("O", "oil"), ("F", "gas"))))
    return readers.commodity_prices(o, "period", {"oil": "($/bbl)", "gas": "($/mmbtu)"}, 6)


def _facts(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("period_end"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("filing_date"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tag"), (F.col("l_returnflag") == "R").alias("is_dimensioned"), F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("numeric_value"), F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_linestatus") == "O", F.lit(None)).otherwise("EUR").alias("unit"))


_FACTS = "facts AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS period_end, CAST(l_shipdate AS DATE) + l_linenumber AS filing_date, l_orderkey || '-' || l_linenumber AS tag, l_returnflag = 'R' AS is_dimensioned, CASE WHEN l_quantity > 1 THEN l_extendedprice END AS numeric_value, CASE WHEN l_returnflag = 'A' THEN 'USD' WHEN l_linestatus = 'O' THEN NULL ELSE 'EUR' END AS unit FROM lineitem), ok AS (SELECT * FROM facts WHERE NOT is_dimensioned AND numeric_value IS NOT NULL AND (unit IS NULL OR unit = 'USD'))"


@query(f"WITH {_FACTS} SELECT ticker, period_end, tag, numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, filing_date DESC, tag) AS r FROM ok) WHERE r = 1")
def a11_latest_fact(spark, d):
    return readers.latest_fact(_facts(spark, d)).select("ticker", "period_end", "tag", "numeric_value")


@query(f"WITH {_FACTS} SELECT ticker, period_end, tag, numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_end ORDER BY filing_date DESC, tag) AS r FROM ok WHERE period_end BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') WHERE r = 1")
def a12_fact_history(spark, d):
    day = lambda s: F.lit(s).cast("date")
    return readers.fact_history(_facts(spark, d), day("1996-01-01"), day("1997-12-31")).select("ticker", "period_end", "tag", "numeric_value")


@query("SELECT ticker, filing_date, accession_no FROM (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession_no, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS r FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01') WHERE r <= 3")
def a13_filings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderkey").alias("accession_no"))
    return readers.filings(o, 3, F.lit("1996-01-01").cast("date")).select("ticker", "filing_date", "accession_no")


@query("SELECT n_name, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS suppliers, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def a20_collect_catalog(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    g = j.groupBy("n_name").agg(F.sort_array(F.collect_list("s_suppkey")).alias("l"), F.count("s_suppkey").alias("n"))
    return g.select("n_name", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).alias("suppliers"), "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'B' || c_custkey WHEN c_custkey % 3 = 1 THEN 'A' || c_custkey END AS ticker FROM customer")
def a20_sec_ticker(spark, d):
    k = F.col("c_custkey").cast("string")
    m = F.pmod("c_custkey", F.lit(3))
    t = F.when(m == 0, F.array(F.concat(k, F.lit(".KS")), F.concat(F.lit("B"), k))).when(m == 1, F.array(F.concat(F.lit("A"), k), k)).otherwise(F.array(F.concat(k, F.lit(".T"))))
    return table(spark, d, "customer").select("c_custkey", readers.sec_ticker(t).alias("ticker"))


# Filters and projections


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def f1_equality(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, l.quality, l.doc_id IS NULL AS unscored FROM documents d LEFT JOIN (SELECT doc_id AS id, quality, doc_id FROM labels) l ON l.id = d.doc_id".replace("SELECT doc_id, l.quality", "SELECT d.doc_id, l.quality"))
def f2_null_filters(spark, d):
    docs, l = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return docs.join(l, docs["doc_id"] == l["id"], "left").select("doc_id", "quality", F.col("id").isNull().alias("unscored"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-06-02' AND l_shipdate <= TIMESTAMP '1996-06-30'")
def f3_half_open(spark, d):
    ts = F.col("l_shipdate")
    return table(spark, d, "lineitem").where((ts > F.lit("1996-06-02").cast("timestamp_ntz")) & (ts <= F.lit("1996-06-30").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def f4_asof_cutoff(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def f5_years(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.year("o_orderdate").between(1996, 1998) & F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1')")
def f9_contains(spark, d):
    return table(spark, d, "documents").where(F.lower("source").contains("src1")).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.03 THEN 'Safe' WHEN l_discount < 0.06 THEN 'Watch' WHEN l_discount < 0.08 THEN 'Elevated' ELSE 'Critical' END AS tier FROM lineitem")
def f13_risk_tier(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.risk_tier(F.col("l_discount"), tuple((t / 10, n) for t, n in RISK_TIERS)).alias("tier"))


@query(f"WITH {B.FORECASTS} SELECT id, CASE WHEN horizon = '1m' THEN prophet_point ELSE holt_winters_point END AS point, CASE WHEN horizon = '1m' THEN prophet_lower END AS lower FROM forecasts")
def f12_fallback_point(spark, d):
    f = B.forecasts(spark, d)
    return views.forecast_summary(f.withColumn("prophet_point", F.when(F.col("horizon") == "1m", F.col("prophet_point"))).withColumn("series_type", F.col("id"))).select(F.col("series_type").alias("id"), "point", "lower")


@query("SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_tax * 20 - 0.5)) AS p FROM lineitem")
def f14_clip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.clip01(F.col("l_tax") * 20 - 0.5).alias("p"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS display FROM orders")
def f15_display_map(spark, d):
    m = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled"))
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(m, F.col("o_orderstatus")).alias("display"))


@query("SELECT title, url, source_tag, country FROM (SELECT nullif(trim(source), '') AS title, 'u' || doc_id AS url, 'gdelt' AS source_tag, lang AS country FROM documents UNION ALL SELECT role, 'c' || conv_id || '-' || turn, 'newsapi', NULL FROM conversations)")
def f17_unify_feeds(spark, d):
    g = table(spark, d, "documents").select(F.col("source").alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("x").alias("domain"), F.col("lang").alias("sourcecountry"), F.lit("20240115T120000Z").alias("seendate"))
    c = table(spark, d, "conversations").select(F.col("role").alias("title"), F.col("text").alias("description"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("url"), F.struct(F.lit("n").alias("name")).alias("source"), F.lit("2024-01-15T00:00:00Z").alias("publishedAt"))
    return readers.unify_news(g, c).select("title", "url", "source_tag", "country")


# Joins


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def j1_inner(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1")
def j4_left_outer(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000")
    return table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("SELECT s_suppkey, l_partkey, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2")
def j6_fan_out(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j10_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j11_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def j18_lookup(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("n_name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def j22_violations(spark, d):
    return sinks.violations(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 5"), "p_partkey").select("l_orderkey", "l_linenumber")


# Aggregates


@query("SELECT o_orderpriority, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def g2_coverage(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.countDistinct("o_custkey").alias("customers"))


@query("WITH s AS (SELECT n_regionkey, n_nationkey, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY n_regionkey) AS t FROM s) SELECT n_regionkey, round(sum((c / t) * (c / t)), 4) AS hhi FROM t GROUP BY 1")
def g6_hhi(spark, d):
    c = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("c"))
    share = c.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("n_regionkey")))
    return share.groupBy("n_regionkey").agg(V.hhi(F.sort_array(F.collect_list("share"))).alias("hhi"))


@query(f"WITH {B.FORECASTS} SELECT horizon, CASE WHEN bool_or(status = 'model_error') THEN 'model_error' WHEN bool_or(status = 'insufficient_data') THEN 'insufficient_data' WHEN bool_or(status = 'unstable_disagreement') THEN 'unstable_disagreement' ELSE 'ok' END AS status, CAST(run_at AS DATE) AS day FROM forecasts GROUP BY 1, 3")
def g8_status_collapse(spark, d):
    f = B.forecasts(spark, d).withColumn("day", F.to_date("run_at"))
    return collapse_status(f, ["horizon", "day"], STATUS_PRIORITY)


@query(f"WITH {B.FORECASTS} SELECT resource_id, id FROM (SELECT *, max(run_at) OVER (PARTITION BY resource_id, series_type) AS m FROM forecasts) WHERE run_at = m")
def g9_latest_run(spark, d):
    return views.latest_runs(B.forecasts(spark, d)).select("resource_id", "id")


@query("SELECT source, count(*) AS n, count(quality) AS labelled, sum(toxic)::BIGINT AS toxic, round(avg(quality), 6) AS quality_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g11_value_counts(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"), R(F.avg("quality")).alias("quality_rate"))


@query("SELECT text_n, count(*) AS texts FROM (SELECT text, count(*) AS text_n FROM documents GROUP BY 1) GROUP BY 1")
def g13_exact_clusters(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("text_n")).groupBy("text_n").agg(F.count("*").alias("texts"))


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS filled, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS other FROM orders GROUP BY 1")
def g15_count_if(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_orderstatus") != "F").alias("other"))


@query("SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, l_returnflag FROM lineitem GROUP BY 1, 4")
def g3_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(f"WITH {B.SIGNALS} SELECT resource_id, count(*) AS n, count(severity) AS n_scored, round(avg(severity), 6) AS mean_severity FROM signals WHERE ts <= TIMESTAMP '1998-01-01' GROUP BY 1")
def g24_signal_stats(spark, d):
    s = B.signals(spark, d).where("ts <= timestamp '1998-01-01'")
    return s.groupBy("resource_id").agg(F.count("*").alias("n"), F.count("severity").alias("n_scored"), R(F.avg("severity")).alias("mean_severity"))


@query(f"WITH {B.FORECASTS} SELECT id, (prophet_point IS NOT NULL)::INT + (CASE WHEN horizon = '1m' THEN 1 ELSE 0 END) + (status = 'ok')::INT AS covered FROM forecasts")
def g25_covered(spark, d):
    cols = [F.col("prophet_point"), F.when(F.col("horizon") == "1m", 1), F.when(F.col("status") == "ok", 1)]
    return B.forecasts(spark, d).select("id", sum(c.isNotNull().cast("int") for c in cols).alias("covered"))


# Windows, order, sets


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def w5_latest(spark, d):
    return views.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r = 1")
def w6_last_turn(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("m")).select("conv_id", "m.turn", "m.role")


@query("SELECT kind, id, pos FROM (SELECT kind, id, row_number() OVER (ORDER BY kind, id) AS pos FROM (SELECT 0 AS kind, event_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'purchase')) WHERE pos <= 200")
def w12_budget(spark, d):
    e = table(spark, d, "events")
    both = e.where("event_type = 'click'").select(F.lit(0).alias("kind"), F.col("event_id").alias("id")).unionByName(e.where("event_type = 'purchase'").select(F.lit(1).alias("kind"), F.col("event_id").alias("id")))
    top = both.orderBy("kind", "id").limit(200)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("kind", "id")).cast("long"))  # at most the budget's rows


@query("SELECT r_name, min_by(n_name, n_nationkey) AS first_nation FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def w15_first_in_catalog(spark, d):
    return table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.min_by("n_name", "n_nationkey").alias("first_nation"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o2_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen_at FROM orders UNION ALL SELECT 'ship', l_orderkey, l_shipdate FROM lineitem WHERE l_quantity > 49 ORDER BY 3 DESC NULLS LAST, 1, 2 LIMIT 20")
def u1_feed(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"))
    b = table(spark, d, "lineitem").where("l_quantity > 49").select(F.lit("ship").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("seen_at"))
    return a.unionByName(b).orderBy(F.desc_nulls_last("seen_at"), "kind", "id").limit(20)


@query("SELECT DISTINCT lower(event_type) AS t FROM events")
def u4_distinct(spark, d):
    return table(spark, d, "events").select(F.lower("event_type").alias("t")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u5_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u5_except(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_orderkey, 'a' AS _side FROM orders WHERE o_orderstatus = 'P'")
def u6_differences(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return sinks.differences(o, table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"))


# Sinks


def _news(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("source_url"), F.col("user_id").alias("resource_id"), "event_id", "value")


@query("SELECT source_url, resource_id, event_id FROM (SELECT event_type AS source_url, user_id AS resource_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events WHERE event_id >= 500) n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id < 500 AND e.event_type = n.source_url AND e.user_id = n.resource_id)")
def s1_append_absent(spark, d):
    n = _news(spark, d)
    return sinks.fresh(n.where("event_id < 500"), n.where("event_id >= 500"), ["source_url", "resource_id"], ["event_id"]).select("source_url", "resource_id", "event_id")


@query("SELECT event_id, k FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS k, row_number() OVER (PARTITION BY CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END ORDER BY event_id) AS r FROM events WHERE event_id >= 60) n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id < 60 AND CASE WHEN e.user_id % 4 = 0 THEN NULL ELSE e.user_id END IS NOT DISTINCT FROM n.k)")
def s2_append_null_safe(spark, d):
    n = table(spark, d, "events").select("event_id", F.when(F.pmod("user_id", F.lit(4)) != 0, F.col("user_id")).alias("k"))
    return sinks.fresh(n.where("event_id < 60"), n.where("event_id >= 60"), ["k"], ["event_id"])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'P')")
def s3_watermark(spark, d):
    o = table(spark, d, "orders")
    return sinks.above_watermark(o.where("o_orderstatus = 'P'"), o, "o_orderdate").select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey, o_orderpriority, 0.0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def s4_replace_groups(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    return sinks.replace_groups(o, new, ["o_orderpriority"]).drop("o_orderstatus")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def s5_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    new = c.where("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0))
    return sinks.upsert(c, new, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 AND d.lang = 'en' THEN 'low' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def s6_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    low = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("low").alias("source"))
    return sinks.update(docs, low, "doc_id", ["source"], F.col("lang") == "en").select("doc_id", "source")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def s10_add_column(spark, d):
    return sinks.add_column(table(spark, d, "nation").select("n_nationkey", "n_name"), "note", "string")


# Views


@query(f"""WITH {B.RESOURCES}, p AS (SELECT o_orderpriority AS resource_id, o_orderkey AS id, o_orderdate AS at, least(1.0, o_totalprice / 500000) AS prob, o_custkey % 2 AS real, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT s.resource_id, prob AS calibrated_probability, CASE WHEN prob IS NULL THEN NULL ELSE real = 0 END AS is_real_data_model, CASE WHEN prob IS NULL THEN 'Not scored' WHEN prob < 0.3 THEN 'Safe' WHEN prob < 0.6 THEN 'Watch' WHEN prob < 0.8 THEN 'Elevated' ELSE 'Critical' END AS tier, 'not_attempted' AS explanation_status FROM resources s LEFT JOIN p ON p.resource_id = s.resource_id AND r = 1""")
def v3_leaderboard(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    p = o.select(F.col("o_orderpriority").alias("resource_id"), F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(2)).cast("string").alias("run_id"), F.col("o_orderdate").alias("predicted_at"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("calibrated_probability"))
    runs = spark.createDataFrame([("0", "real"), ("1", "synthetic_validation")], "run_id string, data_mode string")
    none = spark.createDataFrame([], "resource_id string, status string, generated_at timestamp, id long")
    lb = views.leaderboard(B.resources(spark, d), p, runs, B.forecasts(spark, d), none)
    return lb.select("resource_id", "calibrated_probability", "is_real_data_model", "tier", "explanation_status")


@query(f"WITH {B.FORECASTS} SELECT resource_id, count(*) AS rows_in_run, min(horizon) AS first_horizon FROM (SELECT *, max(run_at) OVER (PARTITION BY resource_id, series_type) AS m FROM forecasts) WHERE run_at = m GROUP BY 1")
def v4_detail(spark, d):
    none = spark.createDataFrame([], "resource_id string, start_week date, end_week date, episode_name string")
    det = views.detail(B.resources(spark, d), B.prices(spark, d), B.forecasts(spark, d), none)
    return det.select("resource_id", F.size("forecasts").cast("long").alias("rows_in_run"), F.array_min(F.transform("forecasts", lambda x: x.horizon)).alias("first_horizon"))


@query("""WITH f AS (SELECT 'prediction' AS kind, o_orderpriority AS resource_id, o_orderdate AS seen_at, 'probability ' || printf('%.1f%%', o_custkey % 100 * 1.0) AS summary, o_orderkey AS id FROM orders UNION ALL SELECT 'explanation', o_orderpriority, o_orderdate, o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT kind, resource_id, seen_at, summary, id FROM f ORDER BY seen_at DESC NULLS LAST, kind, id LIMIT 20""")
def v5_alert_feed(spark, d):
    o = table(spark, d, "orders")
    p = o.select(F.col("o_orderpriority").alias("resource_id"), F.col("o_orderdate").alias("predicted_at"), (F.pmod("o_custkey", F.lit(100)) / 100).alias("calibrated_probability"), F.col("o_orderkey").alias("id"))
    e = o.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("resource_id"), F.col("o_orderdate").alias("generated_at"), F.lit(None).cast("string").alias("narrative"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))
    return views.alert_feed(p, e, B.resources(spark, d)).select("kind", "resource_id", F.col("at").alias("seen_at"), "summary", "id")


@query("""WITH t AS (SELECT o_orderpriority AS resource_id, CAST(o_orderdate AS DATE) AS week, o_totalprice / 500000 AS risk_score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY week DESC, risk_score DESC) AS r FROM t)
SELECT resource_id, week, risk_score, CASE WHEN risk_score < 0.3 THEN 'Safe' WHEN risk_score < 0.6 THEN 'Watch' WHEN risk_score < 0.8 THEN 'Elevated' ELSE 'Critical' END AS tier FROM r WHERE r = 1""")
def v6_latest_scores(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("resource_id"), F.to_date("o_orderdate").alias("week"), (F.col("o_totalprice") / 500000).alias("risk_score"))
    return views.latest_scores(t)


@query("""WITH m AS (SELECT o_orderpriority AS model, round(avg(o_totalprice) / 1000000, 6) AS f1, count(*) / 100000 AS roc_auc FROM orders GROUP BY 1) SELECT model, f1, model = (SELECT max_by(model, (f1, roc_auc, model)) FROM m) AS best FROM m""")
def v9_benchmark_table(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("f1"), (F.count("*") / 100000).alias("roc_auc"))
    return views.benchmark_table(m).select("model", "f1", "best")


@query("""WITH e(event, a, z) AS (VALUES ('spring', DATE '1996-03-01', DATE '1996-05-31')) SELECT event, o_orderkey, CAST(o_orderdate AS DATE) BETWEEN a AND z AS during FROM orders, e WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def v10_case_studies(spark, d):
    e = spark.createDataFrame([("spring", ["1-URGENT", "2-HIGH"])], "event string, resource_ids array<string>").withColumns({"start": F.lit("1996-03-01").cast("date"), "end": F.lit("1996-05-31").cast("date")})
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("resource_id"), F.to_date("o_orderdate").alias("week"), "o_orderkey")
    return views.case_studies(t, e).select("event", "o_orderkey", "during")


