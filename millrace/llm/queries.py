"""The registered queries of this subpackage and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, feistel, jaccard, kmtree, licenses, lines, mtree, pieces, quality, ranking, sharding, suffixes, whitening
from millrace.llm.common import table


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"), k=5, percent=75)


_OP1 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.m) AS component_id FROM s JOIN r USING (doc_id) GROUP BY 1, 2
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def _values(rows: list[tuple]) -> str:
    quote = lambda x: str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_NORMAL = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_BIGRAMS = "list_distinct(CASE WHEN len({0}) > 1 THEN list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) ELSE {0} END)"
_OP4 = f"""
WITH t0(template_id, license, txt) AS (VALUES {_values([(i, a, b) for i, (a, b) in enumerate(licenses.TEMPLATES)])}),
t1 AS (SELECT template_id, license, {_NORMAL.format("txt")} AS w FROM t0),
t AS (SELECT template_id, license, {_BIGRAMS.format("w")} AS tb FROM t1),
u0 AS (SELECT doc_id, text AS ut, -1 AS unit FROM documents WHERE contains(text, chr(10))
       UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) - 1 FROM documents WHERE text IS NOT NULL),
u1 AS (SELECT doc_id, unit, {_NORMAL.format("ut")} AS w FROM u0),
u AS (SELECT doc_id, unit, {_BIGRAMS.format("w")} AS ub FROM u1 WHERE len(w) > 0),
s0 AS (SELECT doc_id, unit, template_id, license, 2 * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice FROM u, t
       WHERE 5 * len(ub) >= 3 * len(tb) AND 5 * len(tb) >= 3 * len(ub)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template_id, unit) AS r, dense_rank() OVER (PARTITION BY doc_id ORDER BY unit) AS du FROM s0 WHERE dice >= 0.75),
b AS (SELECT doc_id, max(du) AS n_units FROM s GROUP BY doc_id)
SELECT d.doc_id, s.license, s.template_id::INT AS template_id, s.unit::INT AS unit, s.dice, coalesce(b.n_units, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.r = 1 LEFT JOIN b ON b.doc_id = d.doc_id
"""

def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.materialise(table(spark, sf_dir, "documents"), key="epoch-0", seq_len=2048, per_shard=4096)


def op8_pieces(spark: SparkSession, sf_dir: str, model: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(model), seed=1)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"), size=400)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "source", "lang", "p_low", "p_toxic", "low_rate", "toxic_rate", "keep")


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP11 = f"""
WITH q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT doc_id, {_TERMS} AS ts FROM documents), d AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM w WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_decontamination, op3_topk, op4_licenses, op5_sharding, op6_line_dedup, op7_training_order, op8_pieces, op9_suffix_dedup, op10_quality, op11_ranking, op12_whitening, op13_neighbours)}
ORACLES: dict[str, str] = {"op1_jaccard": _OP1, "op3_topk": _OP3, "op4_licenses": _OP4, "op11_ranking": _OP11}
