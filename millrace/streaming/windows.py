"""Structured Streaming forms of the incremental batch operators. An extension: the batch operators are the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.sinks import fresh


def weekly(stream: DataFrame, key: str, ts: str, value: str, late: str = "14 days") -> DataFrame:
    """Tumbling ISO weeks (the epoch is a Thursday, hence the offset): key, week, mean, n."""
    w = F.window(F.col(ts), "7 days", "7 days", "4 days")
    return stream.withWatermark(ts, late).groupBy(key, w).agg(F.avg(value).alias("y"), F.count(value).alias("n")).select(key, F.to_date("window.start").alias("week"), "y", "n")


def trailing_weeks(stream: DataFrame, key: str, ts: str, value: str, late: str = "14 days") -> DataFrame:
    """Sliding 28 days that end with each ISO week: key, week, mean, n."""
    w = F.window(F.col(ts), "28 days", "7 days", "4 days")
    return stream.withWatermark(ts, late).groupBy(key, w).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.date_sub(F.to_date("window.end"), 7).alias("week"), "mean", "n")


def once_per_key(stream: DataFrame, keys: list[str], ts: str, late: str = "7 days") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_absent_stream(stream: DataFrame, path: str, keys: list[str], order: list, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Idempotent sink: every micro-batch appends only keys that are not stored, so a replayed batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
        old = spark.read.parquet(path) if there else spark.createDataFrame([], batch.schema)
        fresh(old, batch, keys, order).write.mode("append").parquet(path)
        if after:
            after(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
