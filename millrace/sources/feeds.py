"""The two article feeds: requests as columns, an injected `get(params) -> body` as client, answers parsed by schema.

Every request is made once and its answer written to the shared folder; what failed comes back beside the articles, with its error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.shared import cut
from millrace.sources.readers import fetch, fetched

# Limits and fields of the feeds' contracts.
GDELT_MOST, NEWSAPI_MOST = 250, 100
GDELT_FIELDS = ("title", "url", "domain", "seendate", "sourcecountry", "language")
_GDELT = "struct<articles: array<struct<" + ", ".join(f"{f}: string" for f in GDELT_FIELDS) + ">>>"
_NEWSAPI = "struct<status: string, message: string, articles: array<struct<title: string, url: string, description: string, publishedAt: string, source: struct<id: string, name: string>>>>"


def _clamp(n: int, most: int) -> Column:
    return F.lit(str(max(1, min(int(n), most))))


def _pages(keys: DataFrame, params: Column, get: Callable[[dict], str], retries: int, wait: float) -> tuple[DataFrame, DataFrame]:
    """(page(body), failures(_key, _error)); one request a row of keys."""
    asked = keys.select(F.to_json(params).alias("params"))
    return fetched(cut(fetch(asked, lambda params: [{"body": get(json.loads(params))}], "body string", retries, wait)))


def gdelt_articles(keys: DataFrame, get: Callable[[dict], str], most: int = 250, timespan: str = "1m", retries: int = 3, wait: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Articles (GDELT_FIELDS, blanks as NULL) and failures of keys(terms array<string>, and start, end dates for a window of the past).

    Terms are joined by OR; a window replaces the timespan; keys without terms are not asked.
    """
    has = {"start", "end"} <= set(keys.columns)
    window = (F.col("start").isNotNull() & F.col("end").isNotNull()) if has else F.lit(False)
    stamp = lambda c: F.when(window, F.date_format(c, "yyyyMMddHHmmss")) if has else F.lit(None).cast("string")
    params = F.struct(X.or_query(F.col("terms")).alias("query"), _clamp(most, GDELT_MOST).alias("maxrecords"), F.when(~window, timespan).alias("timespan"), stamp("start").alias("startdatetime"), stamp("end").alias("enddatetime"))
    pages, failed = _pages(keys.where(F.size("terms") > 0), params, get, retries, wait)
    rows = pages.select(F.explode(F.from_json("body", _GDELT)["articles"]).alias("a"))
    return rows.select(*(X.blank_to_null(F.col(f"a.{f}")).alias(f) for f in GDELT_FIELDS)), failed


def newsapi_articles(keys: DataFrame, get: Callable[[dict], str], page: int = 50, language: str = "en", retries: int = 1, wait: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Articles (title, url, source_name, description, publishedAt, language) and failures of keys(query), one page each.

    The feed names no language of its articles: it is that of the request. An answer whose status isn't ok is a failure.
    """
    params = F.struct(F.col("query").alias("q"), _clamp(page, NEWSAPI_MOST).alias("pageSize"), F.lit(language).alias("language"), F.lit("publishedAt").alias("sortBy"))
    pages, failed = _pages(keys.where(F.trim("query") != ""), params, get, retries, wait)
    parsed = pages.select(F.from_json("body", _NEWSAPI).alias("p"), F.col("body"))
    bad = parsed.where(~F.col("p.status").eqNullSafe("ok")).select(F.lit(None).cast("string").alias("_key"), F.coalesce("p.message", "p.status", F.left("body", F.lit(200))).alias("_error"))
    rows = parsed.where(F.col("p.status") == "ok").select(F.explode("p.articles").alias("a"))
    out = rows.select("a.title", "a.url", F.col("a.source.name").alias("source_name"), "a.description", "a.publishedAt", F.lit(language).alias("language"))
    return out, failed.union(bad)
