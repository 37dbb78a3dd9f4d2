"""Readers: JSON documents, price files, filings, news feeds. Network clients are injected callables that return rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import times
from millrace.functions import vectors as V

# File layouts and bounds.
MEMORY_SCHEMA = "date string, category string, series string, metric string, value string, unit string, source string"
CATEGORIES = {"DRAM": "dram", "NAND": "nand", "HBM": "hbm"}
MISSING = ("…", "..", "...", "n/a", "", "nan")
MAX_LOOKBACK, MIN_YEAR = 90, 2021


def json_list(spark: SparkSession, path: str, field: str, ddl: str) -> DataFrame:
    """Rows of the array `field` of a JSON document."""
    doc = spark.read.option("multiLine", True).schema(f"{field} array<struct<{ddl}>>").json(path)
    return doc.select(F.explode(field).alias("r")).select("r.*")


def clamp_lookback(days: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_LOOKBACK), days))


def clean_closes(bars: DataFrame) -> DataFrame:
    """(date, close) rows of bars: a currency known to be other than USD rejects the row, missing closes drop out."""
    return bars.where("currency is null or currency = 'USD'").where("close is not null and not isnan(close)")


def closes_between(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Half-open [start, end)."""
    return clean_closes(bars).where((F.col("date") >= start) & (F.col("date") < end))


def memory_prices(raw: DataFrame, today: Column, categories: dict[str, str] = CATEGORIES, metric: str = "usd_per_gb", min_year: int = MIN_YEAR) -> DataFrame:
    """Long CSV of memory prices -> date, resource_id, price_usd, unit, source, series; other metrics, bad values and future rows drop out."""
    name = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))
    rows = raw.where(F.col("metric") == metric).withColumns({"resource_id": F.try_element_at(name, F.col("category")), "price_usd": F.col("value").try_cast("double"), "day": F.trim("date")})
    rows = rows.where("resource_id is not null and price_usd > 0 and not isnan(price_usd) and day <> ''").where((F.left("day", F.lit(4)) >= str(min_year)) & (F.col("day") <= today.cast("string")))
    series = F.trim(F.coalesce(F.when(F.col("series") != "", F.col("series")), F.lit("unknown")))
    return rows.select(F.col("day").alias("date"), "resource_id", "price_usd", F.lit("USD_per_GB").alias("unit"), F.concat(F.lit("stanford_dam:"), X.slug(series)).alias("source"), series.alias("series"))


def commodity_prices(wide: DataFrame, period: str, units: dict[str, str | None], months_back: int = 3) -> DataFrame:
    """Wide sheet (one text column per commodity) -> date, commodity_name, price, unit of the last months_back rows by period."""
    names = [c for c in wide.columns if c != period and c.strip()]
    rows = wide.withColumn("date", times.period_to_date(F.col(period)))
    last = rows.withColumn("_r", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("date")))).where(F.col("_r") <= max(1, months_back))  # a sheet of months
    long = last.where("date is not null").unpivot(["date"], names, "commodity_name", "raw")
    value = F.when(~F.lower(F.trim("raw")).isin(*MISSING), F.col("raw").try_cast("double"))
    unit = F.create_map(*(F.lit(x) for k, v in units.items() for x in (k, v))) if units else None
    out = long.withColumn("price", V.nan_to_null(value)).where("price is not null")
    return out.select("date", F.trim("commodity_name").alias("commodity_name"), "price", (F.trim(F.try_element_at(unit, F.col("commodity_name"))) if unit is not None else F.lit(None).cast("string")).alias("unit"))


def usable_facts(facts: DataFrame) -> DataFrame:
    return facts.where("not coalesce(is_dimensioned, false) and numeric_value is not null and (unit is null or unit = 'USD')")


def latest_fact(facts: DataFrame, by: str = "ticker") -> DataFrame:
    """Per ticker the usable fact of the greatest (period_end, filing_date), then the smaller tag."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("period_end"), F.desc_nulls_last("filing_date"), "tag")
    return usable_facts(facts).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fact_history(facts: DataFrame, start: Column, end: Column, by: str = "ticker") -> DataFrame:
    """Usable facts in [start, end], of each period the one filed last."""
    w = Window.partitionBy(by, "period_end").orderBy(F.desc_nulls_last("filing_date"), "tag")
    rows = usable_facts(facts).where((F.col("period_end") >= start) & (F.col("period_end") <= end))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def filings(rows: DataFrame, n: int, start: Column | None = None, end: Column | None = None, by: str = "ticker") -> DataFrame:
    """The n latest filings per ticker within optional inclusive bounds."""
    if start is not None:
        rows = rows.where(F.col("filing_date") >= start)
    if end is not None:
        rows = rows.where(F.col("filing_date") <= end)
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("filing_date"), "accession_no")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sec_ticker(tickers: Column) -> Column:
    """First ticker without a dot (exchange suffixes name foreign listings)."""
    return F.try_element_at(F.filter(tickers, lambda t: ~F.contains(t, F.lit("."))), F.lit(1))


def unify_news(gdelt: DataFrame, newsapi: DataFrame) -> DataFrame:
    """Both feeds as title, snippet, url, source_name, country, published, source_tag."""
    b = X.blank_to_null
    g = gdelt.select(b(F.col("title")).alias("title"), F.lit(None).cast("string").alias("snippet"), b(F.col("url")).alias("url"), b(F.col("domain")).alias("source_name"), b(F.col("sourcecountry")).alias("country"), b(F.col("seendate")).alias("published"), F.lit("gdelt").alias("source_tag"))
    n = newsapi.select(b(F.col("title")).alias("title"), b(F.col("description")).alias("snippet"), b(F.col("url")).alias("url"), b(F.col("source.name")).alias("source_name"), F.lit(None).cast("string").alias("country"), b(F.col("publishedAt")).alias("published"), F.lit("newsapi").alias("source_tag"))
    return g.unionByName(n)


def fetch(keys: DataFrame, fn: Callable[..., Iterable[dict]], ddl: str, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Rows from an injected client, one call per row of keys, retried after a pause that doubles each time.

    `_key` (JSON) and `_error` come last: a key that keeps failing gives one row of nulls with its error, so nothing is lost in silence.
    """
    import json
    import time

    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                key = json.dumps(r, default=str, sort_keys=True)
                for turn in range(retries):
                    try:
                        out += [{**x, "_key": key, "_error": None} for x in fn(**r)]
                        break
                    except Exception as e:  # noqa: BLE001  whatever an injected client throws
                        if turn == retries - 1:
                            out.append({"_key": key, "_error": f"{type(e).__name__}: {e}"})
                        else:
                            time.sleep(wait * 2**turn)
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = [*(f.name for f in _schema(ddl)), "_key", "_error"]
    return keys.mapInPandas(run, f"{ddl}, _key string, _error string")


def fetched(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a fetch, and the keys that failed with their errors."""
    return got.where("_error is null").drop("_key", "_error"), got.where("_error is not null").select("_key", "_error")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def csv_or_empty(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, bool]:
    """A CSV export, and whether it was there; a missing file is an empty table and a flag, not an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).schema(ddl).csv(path), True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl), False
