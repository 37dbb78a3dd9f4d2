"""Stored models: every fit is a version of its own, a pointer names the current one, and a run table holds where it came from.

    <root>/<data_mode>/<model_type>/<run_id>/model, /calibrator    ML persistence, written once and never changed
    <root>/<data_mode>/<model_type>/CURRENT                        run_id of the current version, replaced by one rename
    <root>/runs/<data_mode>/<model_type>/<run_id>.parquet          one row of the run table

A version is written before the pointer moves, so a reader finds the old version or the new one, whole. Paths go through Hadoop's file
systems: any store that Spark reaches.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import attribution, models
from millrace.schemas import DATA_MODES, TABLES

TREES = ("xgboost", "lightgbm", "forest")
TOP = 5


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file by one rename, so that it is never seen half written."""
    fs, p = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, target, over)


def save(scorer: models.Scorer, rows: DataFrame, root: str, run_id: str, seed: int = 42, notes: str | None = None) -> str:
    """Stores a fitted scorer with its training rows' facts and makes it current; its path. run_id: larger ones are later."""
    spark = rows.sparkSession
    path = f"{root}/{scorer.mode}/{scorer.kind}/{run_id}"
    scorer.model.write().save(f"{path}/model")
    if scorer.calibrator is not None:
        scorer.calibrator.write().save(f"{path}/calibrator")
    day = F.col("week").cast("date") if "week" in rows.columns else F.lit(None).cast("date")
    r = rows.agg(F.count("*"), F.sum("label"), F.min(day), F.max(day)).first()
    run = spark.createDataFrame([(run_id, None, scorer.mode, r[0], int(r[1] or 0), r[2], r[3], seed, path, scorer.calibrator is not None, notes)], TABLES["training_run"].ddl)
    run.withColumn("run_at", F.current_timestamp()).coalesce(1).write.parquet(f"{root}/runs/{scorer.mode}/{scorer.kind}/{run_id}.parquet")  # one row
    _publish(spark, f"{root}/{scorer.mode}/{scorer.kind}/CURRENT", run_id)
    return path


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The run table, empty where nothing is stored."""
    fs, p = _path(spark, f"{root}/runs")
    return spark.read.schema(TABLES["training_run"].ddl).parquet(f"{root}/runs/*/*/*") if fs.exists(p) else spark.createDataFrame([], TABLES["training_run"].ddl)


class Stored:
    """A loaded version: the scorer, its run_id and the path its trees can be read from."""

    def __init__(self, scorer: models.Scorer, run_id: str, path: str):
        self.scorer, self.run_id, self.path = scorer, run_id, path


def load(spark: SparkSession, root: str, kind: str = "lightgbm", prefer: str = "real") -> Stored | None:
    """The current version of a learner, of `prefer`'s data mode or else the other; None where neither is stored."""
    for mode in sorted(DATA_MODES, key=lambda m: m != prefer):
        fs, p = _path(spark, f"{root}/{mode}/{kind}/CURRENT")
        if not fs.exists(p):
            continue
        run_id = spark.read.text(p.toString()).first()[0]
        path = f"{root}/{mode}/{kind}/{run_id}"
        fs, p = _path(spark, f"{path}/calibrator")
        calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if fs.exists(p) else None
        row = runs(spark, root).where(F.col("model_path") == path).select("data_mode", "n_examples").first()
        model = PipelineModel.load(f"{path}/model")
        return Stored(models.Scorer(model, calibrator, model.stages[0].getInputCols(), row.data_mode if row else mode, kind, row.n_examples if row else 0), run_id, path)
    return None


def _tree_stage(spark: SparkSession, path: str) -> str:
    """Folder of a stored pipeline's last stage."""
    fs, p = _path(spark, f"{path}/model/stages")
    return max((s.getPath().toString() for s in fs.listStatus(p)), key=lambda x: int(x.rsplit("/", 1)[1].split("_")[0]))


def explained(stored: Stored, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with contributions (log-odds, or probability of a forest) and base, and what each contribution counts for: a feature's
    missing flag is added to it."""
    spark, model = rows.sparkSession, stored.scorer.model
    full = models.with_indicators(rows)[0]
    for stage in model.stages[:-1]:
        full = stage.transform(full)
    names = [c.removesuffix("_missing") for c in stored.scorer.columns]
    flat = full.select(*rows.columns, vector_to_array("features").alias("_x"))
    return attribution.attribute(flat, "_x", attribution.model_nodes(spark, _tree_stage(spark, stored.path)), names).drop("_x"), names


def predict(spark: SparkSession, root: str, rows: DataFrame, kind: str = "lightgbm", prefer: str = "real", min_rows: int = models.MIN_REAL_ROWS) -> DataFrame:
    """rows with raw_score, calibrated_probability, provenance (run_id, data_mode, is_real_data_model, model_type, n_examples, warning),
    and the top features with their reason where they are held back; `error` says that nothing is stored."""
    top = "array<struct<feature:string,contribution:double>>"
    none = lambda t: F.lit(None).cast(t)
    stored = load(spark, root, kind, prefer)
    if stored is None:
        return rows.select("*", none("double").alias("raw_score"), none("double").alias("calibrated_probability"), none("string").alias("data_mode"), none("string").alias("model_type"), none("string").alias("run_id"), none("long").alias("n_examples"), F.lit(False).alias("is_real_data_model"), none(top).alias("top_features"), none("string").alias("top_reason"), none("string").alias("warning"), F.lit("no_model_available").alias("error"))
    s = stored.scorer
    out = s.score(rows)
    reason = s.explain_gate(min_rows) if s.kind in TREES or s.mode != "real" else f"no tree model ({s.kind})"
    if reason:
        out = out.withColumn("top_features", none(top))
    else:
        out, names = explained(stored, out)
        out = out.withColumn("top_features", attribution.drivers(F.col("contributions"), names, TOP)).drop("contributions", "base")
    real = s.mode == "real"
    return out.select(*rows.columns, "raw_score", "calibrated_probability", "data_mode", "model_type", F.lit(stored.run_id).alias("run_id"), F.lit(s.n).cast("long").alias("n_examples"), F.lit(real).alias("is_real_data_model"), "top_features", F.lit(reason or None).cast("string").alias("top_reason"), F.lit(None if real else "model of generated rows: no statement about real ones").cast("string").alias("warning"), none("string").alias("error"))
