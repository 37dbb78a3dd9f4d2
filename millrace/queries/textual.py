"""Text, JSON, vectors, clustering, retrieval, extraction checks and learners."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import attribution, cluster, features, models, store, text, views
from millrace.plans import run as plan
from millrace.queries import base, query, series
from millrace.session import table
from millrace.shared import cut, fresh

R = lambda c: F.round(c, 6)


# String functions


@query("SELECT n_nationkey, trim(regexp_replace(lower(n_name || ' (x)'), '[^a-z0-9]', '_', 'g'), '_') AS slug FROM nation")
def x3_slug(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.slug(F.concat("n_name", F.lit(" (x)"))).alias("slug"))


@query("SELECT doc_id, concat_ws(' ', nullif(trim(lang), ''), CASE WHEN doc_id % 2 = 0 THEN nullif(trim(source), '') END) AS joined FROM documents")
def x2_join_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.join_parts(F.col("lang"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source"))).alias("joined"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 220 THEN left(text, 220) || '…' ELSE text END AS snippet, md5(text) AS h FROM conversations")
def x5_snippet(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.snippet(F.col("text")).alias("snippet"), F.md5("text").alias("h"))


_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_WORDS})::INT AS words, array_to_string({_WORDS}[1:120], ' ') AS first_words FROM documents")
def x6_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("words"), X.first_words(F.col("text"), 120).alias("first_words"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS shown FROM lineitem")
def x9_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.percent(F.col("l_discount")).alias("shown"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Forecast available.' WHEN 'F' THEN 'Not enough history to forecast.' ELSE '⚠ Unrecognized forecast status: ''P''' END AS sentence FROM orders")
def x10_sentence(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "insufficient_data").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", views.status_sentence(s, views.FORECAST_SENTENCES, "forecast").alias("sentence"))


@query("SELECT DISTINCT event_type, upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS shown FROM events")
def x11_pretty(spark, d):
    return table(spark, d, "events").select("event_type").distinct().select("event_type", X.pretty(F.col("event_type"), views.FEATURE_NAMES).alias("shown"))


@query("""SELECT s_suppkey, '"' || s_name || '" OR "alt ' || s_suppkey || '"' AS q FROM supplier""")
def x13_query_terms(spark, d):
    k = F.col("s_suppkey").cast("string")
    terms = X.query_terms(F.col("s_name"), F.array(F.upper("s_name"), F.concat(F.lit("alt "), k)), 2)
    return table(spark, d, "supplier").select("s_suppkey", X.or_query(terms).alias("q"))


@query("SELECT o_orderkey, 'sec-xbrl:' || o_custkey || ':' || o_orderstatus AS cid FROM orders")
def x8_composite_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("sec-xbrl:%d:%s", "o_custkey", "o_orderstatus").alias("cid"))


@query("SELECT event_id, trim(coalesce(json_extract_string(props, '$.k'), '')) AS k FROM events")
def q1_json_text(spark, d):
    return table(spark, d, "events").select("event_id", F.trim(F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("k"))


_ANSWERS = """a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '```json {"event_type":"other","severity":' || (user_id % 12) || ',"confidence":0.5,"entities":["a"],"reasoning":"r"} ```'
WHEN 1 THEN 'Sure: {"event_type":"other","severity":5.0,"confidence":0.5,"entities":[],"reasoning":"r"}' WHEN 2 THEN '{"event_type":"other","severity":true,"confidence":0.5,"entities":[],"reasoning":"r"}'
WHEN 3 THEN '{"event_type":"bogus","severity":5,"confidence":0.5,"entities":[],"reasoning":"r"}' WHEN 4 THEN 'no json' ELSE '{"event_type":"demand_signal","severity":7,"confidence":1,"entities":["x"],"reasoning":" "}' END AS raw, user_id FROM events)"""


@query(f"WITH {_ANSWERS} SELECT event_id, event_id % 6 = 0 AND user_id % 12 BETWEEN 1 AND 10 AS ok FROM a")
def q4_validate_extraction(spark, d):
    k = F.pmod("event_id", F.lit(6))
    raw = (
        F.when(k == 0, F.concat(F.lit('```json {"event_type":"other","severity":'), F.pmod("user_id", F.lit(12)).cast("string"), F.lit(',"confidence":0.5,"entities":["a"],"reasoning":"r"} ```')))
        .when(k == 1, 'Sure: {"event_type":"other","severity":5.0,"confidence":0.5,"entities":[],"reasoning":"r"}')
        .when(k == 2, '{"event_type":"other","severity":true,"confidence":0.5,"entities":[],"reasoning":"r"}')
        .when(k == 3, '{"event_type":"bogus","severity":5,"confidence":0.5,"entities":[],"reasoning":"r"}')
        .when(k == 4, "no json").otherwise('{"event_type":"demand_signal","severity":7,"confidence":1,"entities":["x"],"reasoning":" "}'))
    return table(spark, d, "events").select("event_id", text.validate_extraction(raw)["ok"].alias("ok"))


@query("""SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS cited, user_id % 3 <> 0 AS valid FROM events""")
def q5_validate_citations(spark, d):
    u = F.col("user_id")
    cites = F.array(F.struct(u.alias("signal_id"), F.lit(" quoted words ").alias("excerpt")), F.struct(F.lit(-5).cast("long").alias("signal_id"), F.lit("x").alias("excerpt")))
    ids = F.when(F.pmod(u, F.lit(3)) != 0, F.array(u)).otherwise(F.array(F.lit(-9).cast("long")))
    v = text.validate_citations(F.lit("A narrative."), cites, ids)
    return table(spark, d, "events").select("event_id", v["citations"][0]["signal_id"].alias("cited"), v.isNotNull().alias("valid"))


# Matching


_WORDS_OF = "w AS MATERIALIZED (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS ws FROM documents)"


@query(f"WITH {_WORDS_OF} SELECT doc_id, term FROM w, (VALUES ('the'), ('And'), ('of'), ('idiot'), ('et'), ('und'), ('de')) t(term) WHERE list_contains(ws, lower(term))")
def j7_term_match(spark, d):
    terms = spark.createDataFrame([("the",), ("And",), ("of",), ("idiot",), ("et",), ("und",), ("de",)], "term string")
    return text.match_terms(table(spark, d, "documents"), "text", terms, ["doc_id"]).select("doc_id", "term")


@query("""WITH c AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 4),
d AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents)) SELECT doc_id, count(*) AS terms FROM d JOIN c USING (w) GROUP BY 1""")
def j7_large_catalogue(spark, d):
    """Every longer word of the benchmark as a term, over all documents: the catalogue is one automaton, whatever its size."""
    w = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.lower(x))))
    terms = table(spark, d, "benchmark").select(w.alias("term")).where(F.length("term") >= 4).distinct()
    return text.match_terms(table(spark, d, "documents"), "text", terms, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("terms"))


@query("""WITH p AS (SELECT p_partkey, 'Deal on ' || p_brand || ' goods' AS txt FROM part), c AS (SELECT DISTINCT p_brand AS term FROM part), m AS (SELECT p_partkey, term FROM p, c WHERE regexp_matches(txt, '(?i)\\b' || term || '\\b'))
SELECT p_partkey, 'p_' || min_by(term, (-length(term), term)) AS producer_id, 0.99 AS confidence, 'exact_alias' AS method FROM m GROUP BY 1""")
def j8_longest_alias(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Deal on "), "p_brand", F.lit(" goods")).alias("txt"))
    aliases = table(spark, d, "part").select(F.col("p_brand").alias("term")).distinct().withColumn("producer_id", F.concat(F.lit("p_"), "term"))
    return text.resolve_exact(part, "p_partkey", "txt", aliases)


@query(f"""WITH {_WORDS_OF}, r(resource_id, term) AS (VALUES ('a', 'the'), ('a', 'of'), ('b', 'disgusting'), ('c', 'und')), p(producer_id, position, term) AS (VALUES ('y', 2, 'and'), ('x', 1, 'with'), ('z', 3, 'mit')),
m AS (SELECT DISTINCT doc_id, resource_id FROM w, r WHERE list_contains(ws, term)), n AS (SELECT doc_id, min_by(producer_id, (position, producer_id)) AS producer_id FROM w, p WHERE list_contains(ws, term) GROUP BY 1)
SELECT m.doc_id, resource_id, producer_id FROM m LEFT JOIN n USING (doc_id)""")
def k24_tag(spark, d):
    r = spark.createDataFrame([("a", "the"), ("a", "of"), ("b", "disgusting"), ("c", "und")], "resource_id string, term string")
    p = spark.createDataFrame([("y", 2, "and"), ("x", 1, "with"), ("z", 3, "mit")], "producer_id string, position int, term string")
    return text.tag(table(spark, d, "documents"), "doc_id", "text", r, p)


@query("""WITH t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'News from ' || s_name WHEN 1 THEN 'News from ' || left(s_name, 8) || '~' || substr(s_name, 10) ELSE 'Weather' END AS txt, s_name FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'id_' || s_name WHEN 1 THEN 'id_' || s_name END AS producer_id, CASE s_suppkey % 3 WHEN 0 THEN 0.99 WHEN 1 THEN round(2.0 * (length(s_name) - 1) / (2 * length(s_name)), 4) ELSE 0 END AS confidence,
CASE s_suppkey % 3 WHEN 0 THEN 'exact_alias' WHEN 1 THEN 'fuzzy' ELSE 'unresolved' END AS method FROM t""")
def k22_resolve(spark, d):
    """Suppliers named whole, with one character wrong, or not at all; the embedding layer has nothing near."""
    s, k = table(spark, d, "supplier"), F.pmod("s_suppkey", F.lit(3))
    aliases = s.select(F.concat(F.lit("id_"), "s_name").alias("producer_id"), F.col("s_name").alias("term"), F.col("s_suppkey").alias("position"))
    docs = s.select("s_suppkey", F.when(k == 0, F.concat(F.lit("News from "), "s_name")).when(k == 1, F.concat(F.lit("News from "), F.left("s_name", F.lit(8)), F.lit("~"), F.substring("s_name", 10, 100))).otherwise(F.lit("Weather")).alias("txt"))
    return text.resolve(docs, "s_suppkey", "txt", aliases, text.hashed_embedding, {"id_far": "zzzz qqqq"})


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'exact_alias' WHEN 1 THEN 'fuzzy' ELSE 'unresolved' END AS method, count(*) AS n FROM supplier GROUP BY 1")
def g14_outcomes(spark, d):
    return text.outcomes(k22_resolve(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS old_producer, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS new_producer, (CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END) IS DISTINCT FROM (CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END) AS changed FROM orders")
def k23_reprocess(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.col("o_orderstatus")).alias("producer_id"))
    new = o.select("o_orderkey", F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.col("o_orderstatus")).alias("producer_id"), F.lit("m").alias("method"), F.lit(1.0).alias("confidence"))
    return text.reprocess(old, new, "o_orderkey").select("o_orderkey", "old_producer", "new_producer", "changed")


@query("WITH s AS (SELECT doc_id AS signal_id, CASE WHEN lang = 'en' THEN 'news_raw' ELSE 'demand_intent_raw' END AS signal_type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), m AS (SELECT min(doc_id) AS signal_id FROM documents GROUP BY text) SELECT signal_id, 0 AS kind FROM s WHERE signal_type = 'news_raw' AND signal_id IN (SELECT signal_id FROM m) UNION ALL SELECT signal_id, 1 FROM s WHERE signal_type <> 'news_raw'")
def k27_eligible(spark, d):
    docs = table(spark, d, "documents")
    s = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("severity")), "doc_id", "left").select(F.col("doc_id").alias("signal_id"), F.when(F.col("lang") == "en", "news_raw").otherwise("demand_intent_raw").alias("signal_type"), "severity")
    m = docs.groupBy("text").agg(F.min("doc_id").alias("signal_id")).select("signal_id", F.lit(True).alias("is_canonical"))
    return text.eligible(s, m).select("signal_id", "kind")


@query("""WITH f AS (SELECT md5(text) AS h, doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents), c AS (SELECT h, min_by(doc_id, (coalesce(source, ''), doc_id)) AS canonical_id FROM f GROUP BY 1)
SELECT doc_id, 'c_' || canonical_id AS cluster_id, doc_id = canonical_id AS is_canonical FROM f JOIN c USING (h)""")
def k21_memberships(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "source", F.lit(None).cast("timestamp").alias("ts"))
    return cluster.memberships(docs, "h", "doc_id", "ts", "source")


# Vectors

_COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def m1_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", R(V.norm(F.col("embedding"))).alias("norm"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS}, 6) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND {_COS} >= 0.3")
def j9_similar_pairs(spark, d):
    return cluster.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).select("a", "b", R("sim").alias("sim"))


@query(f"""WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND {_COS} >= 0.45), r(id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m) SELECT id, min(m) AS component FROM r GROUP BY 1""")
def k20_clusters(spark, d):
    return cluster.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.45)


@query("""WITH c AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY embedding), q AS (SELECT label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]) AS sim FROM embeddings e JOIN q USING (label) WHERE vec_id IN (SELECT vec_id FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM s WHERE sim >= 0.3) SELECT label::VARCHAR AS resource_id, CAST(r AS INT) AS rank, vec_id AS signal_id, round(sim, 6) AS similarity FROM r WHERE r <= 5""")
def k25_retrieve(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("signal_id"), F.col("label").cast("string").alias("resource_id"), "embedding")
    q = e.groupBy("resource_id").agg(F.min_by("embedding", "signal_id").alias("query_vector"))
    canonical = e.groupBy("embedding").agg(F.min("signal_id").alias("signal_id")).select("signal_id")
    return cluster.retrieve(e, q, canonical).withColumn("similarity", R("similarity"))


@query()
def k20_density(spark, d):
    return cluster.cluster_rows(table(spark, d, "embeddings"), "vec_id", "embedding")


# Learners and runs


@query()
def a22_synthetic(spark, d):
    """A generated training row for every order."""
    return models.synthetic(spark, ids=table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


def _training(spark, d):
    """The feature rows of every resource and week, labelled by whether the next observed week's price is higher; written once, as
    learners read them many times. (The curated stand-in of k7 has one class only.)"""
    after = F.lead("y").over(Window.partitionBy("resource_id").orderBy("week"))
    rises = base.weekly(spark, d).select("resource_id", F.col("week").alias("week_start"), (after > F.col("y")).cast("int").alias("label"), F.lit("price_derived").alias("source"), F.when(after.isNotNull(), "ok").otherwise("insufficient_data").alias("status"))
    return cut(features.training_table(rises, series._features(spark, d)))


_KEYS = ["resource_id", "week"]


@query()
def k14_fit_predict(spark, d):
    rows = _training(spark, d)
    out = models.fit(rows, "lightgbm", _KEYS, rounds=20).score(rows)
    return out.select(*_KEYS, "label", R("raw_score").alias("raw_score"), R("calibrated_probability").alias("calibrated_probability"), "data_mode", "model_type")


@query()
def k15_perceptron(spark, d):
    rows = _training(spark, d)
    return models.fit(rows, "ft", _KEYS).score(rows).select(*_KEYS, "label", "raw_score", "calibrated_probability")


@query()
def k19_folds(spark, d):
    return models.cross_validate(_training(spark, d), "lightgbm", _KEYS, rounds=10)


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders), n AS (SELECT label, count(*) AS c FROM r GROUP BY 1)
SELECT label, CAST(f AS INT) AS fold, CAST(c // 5 + CASE WHEN f < c % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM n, range(5) t(f)""")
def k19_fold_sizes(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return models.stratified(rows, ["o_orderkey"], 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query()
def k17_predict(spark, d):
    rows = _training(spark, d)
    root = fresh(spark, "models")
    store.save(models.fit(rows, "lightgbm", _KEYS, rounds=20), rows, root, "run-1")
    return store.predict(spark, root, rows.drop("label", "label_source"))


@query()
def k18_tree_drivers(spark, d):
    """Top drivers of each resource's latest row, and beside them the features' importance over all rows."""
    rows = _training(spark, d)
    root = fresh(spark, "models")
    store.save(models.fit(rows, "xgboost", _KEYS, rounds=20), rows, root, "run-1")
    out, names = store.explained(store.load(spark, root, "xgboost"), rows)
    latest = out.groupBy("resource_id").agg(F.max_by(F.struct("week", "contributions"), F.struct("week", "label_source")).alias("x"))
    tops = latest.select("resource_id", "x.week", F.posexplode(attribution.drivers(F.col("x.contributions"), names, 5)).alias("i", "t"))
    return tops.select("resource_id", "week", (F.col("i") + 1).alias("rank"), "t.feature", R("t.contribution").alias("contribution"))


# Two small trees over lineitem: (tree, weight, id, feature, threshold, left, right, value); a feature repeats on one path.
_TREES = [
    (0, 0.5, 0, 0, 25.0, 1, 2, 0.0), (0, 0.5, 1, 1, 0.05, 3, 4, 0.0), (0, 0.5, 2, 2, 0.04, 5, 6, 0.0), (0, 0.5, 3, -1, 0.0, -1, -1, 1.0), (0, 0.5, 4, -1, 0.0, -1, -1, -0.5), (0, 0.5, 5, -1, 0.0, -1, -1, 0.25), (0, 0.5, 6, -1, 0.0, -1, -1, -1.25),
    (1, 2.0, 0, 1, 0.03, 1, 2, 0.0), (1, 2.0, 1, 0, 10.0, 3, 4, 0.0), (1, 2.0, 2, -1, 0.0, -1, -1, -0.75), (1, 2.0, 3, -1, 0.0, -1, -1, 0.5), (1, 2.0, 4, 1, 0.01, 5, 6, 0.0), (1, 2.0, 5, -1, 0.0, -1, -1, 0.125), (1, 2.0, 6, -1, 0.0, -1, -1, -0.375),
]
_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _subsets_sql() -> str:
    """Shapley values by the sum over all subsets, each tree's expectation walked node by node."""
    nodes = {(t, i): r for t, _, i, *_ in _TREES for r in _TREES if r[0] == t and r[2] == i}
    counts = {}

    def count(t: int, i: int, path: str) -> None:
        counts[t, i] = f"CAST(count(*) FILTER ({path}) AS DOUBLE) AS c{t}_{i}"
        _, _, _, f, at, left, right, _ = nodes[t, i]
        if left >= 0:
            count(t, left, f"{path} AND {_COLUMNS[f]} <= {at}")
            count(t, right, f"{path} AND NOT {_COLUMNS[f]} <= {at}")

    def walk(t: int, i: int, known: frozenset) -> str:
        _, _, _, f, at, left, right, value = nodes[t, i]
        if left < 0:
            return str(value)
        a, b = walk(t, left, known), walk(t, right, known)
        return f"CASE WHEN {_COLUMNS[f]} <= {at} THEN {a} ELSE {b} END" if f in known else f"(({a}) * c{t}_{left} + ({b}) * c{t}_{right}) / c{t}_{i}"

    roots = {t: w for t, w, *_ in _TREES}
    for t in roots:
        count(t, 0, "true")
    of = lambda s: " + ".join(f"{w} * ({walk(t, 0, frozenset(s))})" for t, w in roots.items())
    n = len(_COLUMNS)
    parts = []
    for i, c in enumerate(_COLUMNS):
        rest = [j for j in range(n) if j != i]
        sets = [s for k in range(n) for s in itertools.combinations(rest, k)]
        w = lambda s: math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
        parts.append("round(" + " + ".join(f"{w(s)} * (({of((*s, i))}) - ({of(s)}))" for s in sets) + f", 6) AS {c.removeprefix('l_')}")
    return f"WITH c AS (SELECT {', '.join(counts.values())} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(parts)}, round({of(())}, 6) AS base FROM lineitem, c"


@query(_subsets_sql())
def k18_tree_attribution(spark, d):
    nodes = spark.createDataFrame(_TREES, "tree int, weight double, id int, feature int, threshold double, left int, right int, value double")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*_COLUMNS).alias("x"))
    out = attribution.attribute(rows, "x", attribution.measured_cover(rows, "x", nodes), _COLUMNS)
    return out.select("l_orderkey", "l_linenumber", *(R(F.col("contributions")[i]).alias(c.removeprefix("l_")) for i, c in enumerate(_COLUMNS)), R("base").alias("base"))


@query("SELECT CASE WHEN count(*) >= 50 THEN 'real' ELSE 'synthetic_validation' END AS data_mode, count(*) AS n FROM labels")
def k13_data_mode(spark, d):
    n = table(spark, d, "labels").count()
    return spark.createDataFrame([(models.data_mode(n), n)], "data_mode string, n long")


@query()
def v7_run(spark, d):
    """The seven stages over the tables, each reading what those before it have written; the log says how many rows each made."""
    root = fresh(spark, "run")
    count = lambda df: f"{df.count()} rows"

    def ingest(c):
        c["weekly"] = cut(base.weekly(spark, d))
        return count(c["weekly"])

    def understand(c):
        c["signals"] = cut(base.signals(spark, d).where("severity is not null"))
        return count(c["signals"])

    def engineer(c):
        c["features"] = cut(series._features(spark, d))
        return count(c["features"])

    def label(c):
        after = F.lead("y").over(Window.partitionBy("resource_id").orderBy("week"))
        rises = c["weekly"].select("resource_id", F.col("week").alias("week_start"), (after > F.col("y")).cast("int").alias("label"), F.lit("price_derived").alias("source"), F.when(after.isNotNull(), "ok").otherwise("insufficient_data").alias("status"))
        c["train"] = cut(features.training_table(rises, c["features"]))
        return count(c["train"])

    def predict(c):
        store.save(models.fit(c["train"], "logistic", _KEYS), c["train"], root, "run-1")
        c["scored"] = cut(store.predict(spark, root, c["features"], "logistic"))
        return count(c["scored"])

    def explain(c):
        raise plan.Skip("no language model configured")

    def deliver(c):
        latest = views.latest(c["scored"].withColumnRenamed("calibrated_probability", "risk_score"), ["resource_id"], "week", "risk_score")
        return count(latest.where("risk_score between 0 and 1"))

    return plan.run(spark, {f.__name__: f for f in (ingest, understand, engineer, label, predict, explain, deliver)})[0]
