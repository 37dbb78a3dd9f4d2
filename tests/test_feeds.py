"""Article feeds through a stub client, table contracts and report files."""

import json

from pyspark.sql import functions as F

from millrace import schemas
from millrace.sources import feeds, sinks


def test_gdelt(spark):
    def get(p):
        if "boom" in p["query"]:
            raise ValueError("rate limit")
        return json.dumps({"articles": [{"title": p["query"], "url": " ", "domain": p.get("timespan") or p["startdatetime"] + "-" + p["enddatetime"], "seendate": p["maxrecords"], "extra": 1}]})

    keys = spark.createDataFrame([(["DRAM", "Big Memory"], None, None), (["a"], "2024-01-01", "2024-02-01"), (["boom"], None, None), ([], None, None)], "terms array<string>, start string, end string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    rows, failed = feeds.gdelt_articles(keys, get, most=9999, wait=0.0)
    got = sorted(tuple(r) for r in rows.collect())
    assert rows.columns == list(feeds.GDELT_FIELDS)
    assert got == [('"DRAM" OR "Big Memory"', None, "1m", "250", None, None), ('"a"', None, "20240101000000-20240201000000", "250", None, None)]
    assert [r._error for r in failed.collect()] == ["ValueError: rate limit"]


def test_newsapi(spark):
    def get(p):
        if p["q"] == "bad":
            return json.dumps({"status": "error", "message": "no key"})
        if p["q"] == "html":
            return "<html>"
        return json.dumps({"status": "ok", "articles": [{"title": "t", "url": "u", "source": {"id": None, "name": "paper"}, "description": None, "publishedAt": p["pageSize"]}, {"title": "no source"}]})

    keys = spark.createDataFrame([("x",), ("bad",), ("html",), (" ",)], "query string")
    rows, failed = feeds.newsapi_articles(keys, get, page=500, language="de")
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted([("t", "u", "paper", None, "100", "de"), ("no source", None, None, None, None, "de")], key=str)
    assert sorted(r._error for r in failed.collect()) == ["<html>", "no key"]


def test_tables_start_empty_and_tell_their_columns(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    schemas.init(spark, root)
    schemas.init(spark, root)
    for name, t in schemas.TABLES.items():
        df = spark.read.parquet(f"{root}/{name}.parquet")
        assert df.count() == 0 and set(t.key) <= set(df.columns)
    price = spark.read.parquet(f"{root}/price_series.parquet")
    assert schemas.is_nullable(price, "unit") and schemas.is_nullable(price, "not there")


def test_logs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").repartition(2)
    log = f"file://{tmp_path}/log"
    sinks.append_log(df, log)
    sinks.append_log(df.limit(1), log)
    assert spark.read.json(log).count() == 3
    small, large = f"file://{tmp_path}/small", f"file://{tmp_path}/large"
    sinks.export_csv(df, small)
    sinks.export_csv(df, large, most=1)
    count = lambda p: len([f for f in (tmp_path / p).iterdir() if f.name.startswith("part")])
    assert count("small") == 1 and count("large") == 2 and spark.read.option("header", True).csv(large).count() == 2
