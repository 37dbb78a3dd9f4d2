"""Catalog matching over text: coarse tagging, layered entity resolution, extraction and narration checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import embedding
from millrace.operators.dictionary import catalogue, match_terms
from millrace.operators.fuzzy import Index
from millrace.schemas import EVENT_TYPES, MIN_EMBEDDING_MATCH

EXACT_CONFIDENCE, FUZZY_THRESHOLD, FUZZY_MIN_LENGTH = 0.99, 88.0, 4


def tag(docs: DataFrame, key: str, text: str, resources: DataFrame, producers: DataFrame) -> DataFrame:
    """key, resource_id (one row per match), producer_id (first matching producer in catalog order, NULL without).

    resources(resource_id, term); producers(producer_id, position, term). Documents without a resource are left out.
    """
    both = resources.select("resource_id", "term").unionByName(producers.select("producer_id", "position", "term"), allowMissingColumns=True)
    found = match_terms(docs, text, both, [key]).groupBy(key).agg(  # one pass over the texts; at most the catalogue's resources a document
        F.collect_set("resource_id").alias("resources"), F.min_by("producer_id", F.when(F.col("producer_id").isNotNull(), F.struct("position", "producer_id"))).alias("producer_id"))
    return found.select(key, F.explode("resources").alias("resource_id"), "producer_id")


def _order(aliases: DataFrame) -> str:
    """What stands for catalogue order: `position` where the catalogue has it, else the producer's id."""
    return "position" if "position" in aliases.columns else "producer_id"


def resolve_exact(docs: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, producer_id, confidence, method: the longest alias that matches wins, then the first in catalogue order."""
    hit = match_terms(docs, text, aliases, [key])
    best = hit.groupBy(key).agg(F.min_by("producer_id", F.struct(-F.length("term"), _order(aliases))).alias("producer_id"))
    return best.select(key, "producer_id", F.lit(EXACT_CONFIDENCE).alias("confidence"), F.lit("exact_alias").alias("method"))


_RESOLVED = "producer_id string, confidence double, method string"


def resolve(docs: DataFrame, key: str, text: str, aliases: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, descriptions: dict[str, str] | None = None, load: Callable[[], Callable] | None = None) -> DataFrame:
    """Three layers, each fed only with what the one before left open: exact, fuzzy (partial ratio), embedding; then unresolved.

    aliases(producer_id, term, and position for catalogue order). Of equal scores the first in catalogue order wins; descriptions are
    in that order. `load` makes the embedding model on the executors, once a worker; `embed` is one that is there already. Texts go to it
    by batch, and where it fails they are unresolved.
    """
    spark = docs.sparkSession
    exact = resolve_exact(docs, key, text, aliases)
    open_ = docs.select(key, text).join(exact.select(key), key, "left_anti")
    known = sorted((r for r in catalogue(aliases) if r.term and len(r.term) >= FUZZY_MIN_LENGTH), key=lambda r: (r[_order(aliases)] is None, r[_order(aliases)], r.term))
    owners = [r.producer_id for r in known]
    shared = spark.sparkContext.broadcast(Index([r.term for r in known], FUZZY_THRESHOLD))
    names = list(descriptions or {})
    load = load or ((lambda: embed) if embed else None)
    model = embedding.broadcast(spark, load) if load and names else None

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[tuple] = [(None, 0.0, "unresolved")] * len(texts)
            left, scores = [], {}
            for i, t in enumerate(texts):
                if t and t not in scores:
                    scores[t] = shared.value.best(t)
                if t and (best := scores[t]):
                    out[i] = (owners[best[0]], round(best[1] / 100, 4), "fuzzy")
                elif t:
                    left.append(i)
            if left and model is not None:
                about = model.value.fixed("descriptions", [descriptions[n] for n in names])
                if all(v is not None for v in about):
                    d = np.stack(about)
                    for i, v in zip(left, model.value.vectors([texts[i] for i in left]), strict=True):
                        if v is None:
                            continue
                        length = np.linalg.norm(d, axis=1) * np.linalg.norm(v)
                        near = np.where(length > 0, d @ v / np.where(length > 0, length, 1), 0.0)
                        if near.max() >= MIN_EMBEDDING_MATCH:
                            out[i] = (names[int(near.argmax())], round(float(near.max()), 4), "embedding")
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.string())]
            yield pa.record_batch([b.column(0), *columns], [key, "producer_id", "confidence", "method"])

    spread = open_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), text)  # equal texts meet and are scored once; small tables too use all tasks
    rest = spread.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {_RESOLVED}")
    return exact.unionByName(rest)


def outcomes(resolved: DataFrame) -> DataFrame:
    """method, n: how many rows each layer resolved, and how many none did; a method without rows is absent."""
    return resolved.groupBy("method").agg(F.count("*").alias("n"))


def hashed_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """Default embed function: signed hashing of character trigrams, L2-normalised. Deterministic, offline."""
    import zlib

    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        s = f"  {(t or '').lower()} "
        for j in range(len(s) - 2):
            h = zlib.crc32(s[j : j + 3].encode())
            out[i, h % dims] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def reprocess(old: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Old and new producer of every row, and whether it changed (NULLs compared as values)."""
    j = old.select(key, F.col("producer_id").alias("old_producer")).join(resolved.select(key, F.col("producer_id").alias("new_producer"), "method", "confidence"), key, "left")
    return j.withColumn("changed", ~F.col("old_producer").eqNullSafe(F.col("new_producer")))


def validate_extraction(raw: Column) -> Column:
    """struct(ok, event_type, severity, confidence, entities, reasoning) of a model's raw answer; ok is false for anything off contract.

    Types are strict: 5 is a severity, 5.0, true and "5" are none.
    """
    v = F.try_parse_json(X.extract_json_object(raw))
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    severity, confidence = get("severity", "long"), get("confidence", "double")
    ok = (
        (kind("event_type") == "STRING") & get("event_type", "string").isin(*EVENT_TYPES)
        & (kind("severity") == "BIGINT") & severity.between(1, 10)
        & kind("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & confidence.between(0, 1)
        & kind("entities").startswith("ARRAY")
        & (kind("reasoning") == "STRING") & (F.trim(get("reasoning", "string")) != "")
    )
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), get("event_type", "string").alias("event_type"), severity.alias("severity"), confidence.alias("confidence"), get("entities", "array<string>").alias("entities"), get("reasoning", "string").alias("reasoning"))


def validate_citations(narrative: Column, citations: Column, evidence_ids: Column, max_words: int = 120, max_excerpt: int = 25) -> Column:
    """struct(narrative, citations): citations of retrieved evidence with short excerpts are kept; NULL if the text is empty or none is left."""
    kept = F.filter(citations, lambda c: F.array_contains(evidence_ids, c.signal_id) & (F.size(X.words(F.coalesce(c.excerpt, F.lit("")))) <= max_excerpt))
    kept = F.transform(kept, lambda c: F.struct(c.signal_id.alias("signal_id"), F.trim(F.coalesce(c.excerpt, F.lit(""))).alias("excerpt")))
    text = F.when(F.size(X.words(narrative)) > max_words, X.first_words(narrative, max_words)).otherwise(F.trim(narrative))
    return F.when((F.trim(narrative) != "") & (F.size(kept) > 0), F.struct(text.alias("narrative"), kept.alias("citations")))


DISCLAIMER = "⚠ Based on synthetic validation data; not a validated prediction."


def with_disclaimer(narrative: Column, is_real: Column) -> Column:
    return F.when(is_real, narrative).otherwise(F.concat(F.lit(f"{DISCLAIMER}\n\n"), narrative))


def explain(prompts: DataFrame, generate: Callable[[str], dict | None], attempts: int = 2) -> DataFrame:
    """prompts(resource_id, prompt, evidence array<long>, is_real) -> narrative, citations, status; generate is injected and may fail."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                status, got = ("insufficient_evidence", None) if not len(r.evidence if r.evidence is not None else []) else ("llm_error", None)
                for _ in range(attempts if status == "llm_error" else 0):
                    try:
                        got = generate(r.prompt)
                    except Exception:
                        got = None
                    if got:
                        break
                out.append((r.resource_id, status, (got or {}).get("narrative"), [{"signal_id": int(c["signal_id"]), "excerpt": str(c.get("excerpt", ""))} for c in (got or {}).get("citations", []) if str(c.get("signal_id", "")).lstrip("-").isdigit()]))
            yield pd.DataFrame(out, columns=["resource_id", "status", "narrative", "citations"])

    raw = prompts.select("resource_id", "prompt", "evidence").mapInPandas(run, "resource_id string, status string, narrative string, citations array<struct<signal_id:long,excerpt:string>>")
    j = raw.join(prompts.select("resource_id", "evidence", "is_real"), "resource_id")
    v = validate_citations(F.col("narrative"), F.col("citations"), F.col("evidence"))
    j = j.withColumn("v", v)
    status = F.when(F.col("narrative").isNull(), F.col("status")).when(F.col("v").isNull(), "invalid_citations").otherwise("ok")
    return j.select("resource_id", status.alias("status"), with_disclaimer(F.col("v.narrative"), F.col("is_real")).alias("narrative"), F.col("v.citations").alias("citations"), F.size("evidence").alias("evidence_count"), F.col("is_real").alias("is_real_data_model"))


def eligible(signals: DataFrame, membership: DataFrame, budget: int | None = None, force: bool = False) -> DataFrame:
    """Backlog for extraction: canonical news first, then demand, unscored (or all with force), at most `budget` rows by id."""
    open_ = signals if force else signals.where("severity is null")
    news = open_.where("signal_type = 'news_raw'").join(membership.where("is_canonical").select(F.col("signal_id").cast("long").alias("signal_id")), "signal_id", "left_semi").withColumn("kind", F.lit(0))
    rows = news.unionByName(open_.where("signal_type = 'demand_intent_raw'").withColumn("kind", F.lit(1)))
    return rows if budget is None else rows.orderBy("kind", "signal_id").limit(budget)


def extract(rows: DataFrame, generate: Callable[[str], str | None], prompt: Column) -> DataFrame:
    """rows with prompt -> signal_id and the validated answer of an injected model, in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"signal_id": b.signal_id, "raw": [generate(p) for p in b.prompt]})

    raw = rows.select("signal_id", prompt.alias("prompt")).mapInPandas(run, "signal_id long, raw string")
    return raw.withColumn("v", validate_extraction(F.col("raw"))).select("signal_id", "raw", "v.*")


# Error codes of the judgment contract.
JUDGMENT_ERRORS = ("no_llm_provider", "llm_call_failed", "unparseable_llm_output", "non_numeric_probability", "probability_out_of_range")


def validate_judgment(raw: Column) -> Column:
    """struct(error, probability, rationale) of a model's raw answer: NULL answers, what holds no such object, what is no number and what
    lies outside [0, 1] have their codes; numbers in quotes count, and so do true and false, as 1 and 0."""
    v = F.try_parse_json(X.extract_json_object(raw))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.tightening_probability", "variant"))
    text_ = F.trim(F.try_variant_get(v, "$.tightening_probability", "string"))
    p = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.tightening_probability", "boolean").cast("double")).when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"), text_.try_cast("double"))
    error = (
        F.when(raw.isNull(), JUDGMENT_ERRORS[1]).when(v.isNull() | kind.isNull(), JUDGMENT_ERRORS[2])
        .when(p.isNull(), JUDGMENT_ERRORS[3]).when(F.isnan(p) | ~p.between(0, 1), JUDGMENT_ERRORS[4]))
    return F.struct(error.alias("error"), F.when(error.isNull(), p).alias("probability"), F.when(error.isNull(), F.trim(F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit("")))).alias("rationale"))


def first_answer(providers: list[tuple[str, Callable[[str], str | None]]]) -> Callable[[str], tuple[str | None, str | None]]:
    """Asks injected models in order until one answers: (answer, its name), or (None, None). One that fails counts as silent."""
    def ask(prompt: str) -> tuple[str | None, str | None]:
        for name, fn in providers:
            try:
                answer = fn(prompt)
            except Exception:  # noqa: BLE001  whatever an injected client throws
                answer = None
            if answer:
                return answer, name
        return None, None

    return ask


def rotating(keys: list, fn: Callable[[object, str], str | None]) -> Callable[[str], str | None]:
    """One model behind several keys: a key that fails gives way to the next, and the one that worked is asked first from then on."""
    order = list(keys)

    def ask(prompt: str) -> str | None:
        for key in list(order):
            try:
                return fn(key, prompt)
            except Exception:  # noqa: BLE001
                order.append(order.pop(0))
        return None

    return ask


def judge(prompts: DataFrame, key: str, providers: list[tuple[str, Callable[[str], str | None]]]) -> DataFrame:
    """prompts(key, prompt) -> key, probability, rationale, provider, error, and that this is no calibrated model."""
    none = F.lit(None).cast("string")
    if not providers:
        got = prompts.select(key, none.alias("raw"), none.alias("provider"))
        verdict = F.struct(F.lit(JUDGMENT_ERRORS[0]).alias("error"), F.lit(None).cast("double").alias("probability"), none.alias("rationale"))
    else:
        ask = first_answer(providers)

        def run(batches):
            for b in batches:
                out = [ask(p) for p in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array([r for r, _ in out], pa.string()), pa.array([n for _, n in out], pa.string())], [key, "raw", "provider"])

        got = prompts.select(key, "prompt").mapInArrow(run, f"`{key}` {dict(prompts.dtypes)[key]}, raw string, provider string")
        verdict = validate_judgment(F.col("raw"))
    return got.withColumn("v", verdict).select(key, F.col("v.probability").alias("tightening_probability"), "v.rationale", "provider", "v.error", F.lit("llm_reasoner").alias("method"), F.lit(False).alias("is_calibrated"), F.lit(False).alias("is_real_data_model"))
