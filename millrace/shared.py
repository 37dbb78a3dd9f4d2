"""The folder that all executors share, and plans cut there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cuts: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder is made only if all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what lies there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _cuts[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans restart from the files, whatever executors are lost."""
    path = fresh(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*done: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more."""
    for df in done:
        _delete(df.cut_path)


def _delete(path: str) -> None:
    spark = _cuts.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _end() -> None:
    for path in list(_cuts):
        _delete(path)
