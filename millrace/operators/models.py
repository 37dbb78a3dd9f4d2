"""Learners: estimator factory, synthetic data, calibration, cross-validation and scored provenance."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import metrics
from millrace.schemas import FEATURES, MIN_REAL_ROWS
from millrace.shared import cut


def data_mode(n: int) -> str:
    return "real" if n >= MIN_REAL_ROWS else "synthetic_validation"


def with_indicators(rows: DataFrame, features=FEATURES) -> tuple[DataFrame, list[str]]:
    """Learners take no NULL: 0 stands for it, beside a 0/1 column that tells it from a true 0."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features}
    return rows.withColumns({**flags, **{c: F.coalesce(V.nan_to_null(F.col(c)), F.lit(0.0)) for c in features}}), [*features, *flags]


def estimator(kind: str, columns: list[str], seed: int = 42, rounds: int | None = None) -> Pipeline:
    """'xgboost' and 'lightgbm' name boosted trees with those settings; 'ft' is the perceptron 128-64-32; 'forest', 'logistic'.

    rounds: boosting rounds or trees, where other than the learner's own.
    """
    kinds = {
        "xgboost": lambda: GBTClassifier(maxIter=rounds or 200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, weightCol="weight", seed=seed),
        "lightgbm": lambda: GBTClassifier(maxIter=rounds or 100, maxDepth=5, stepSize=0.1, seed=seed),
        "ft": lambda: MultilayerPerceptronClassifier(layers=[len(columns), 128, 64, 32, 2], maxIter=30, seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=rounds or 100, maxDepth=6, seed=seed),
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=1e-3),
    }
    if kind not in kinds:
        raise ValueError(f"unknown learner {kind!r}; known: {sorted(kinds)}")
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), kinds[kind]().setLabelCol("label")])


def weigh(rows: DataFrame) -> DataFrame:
    """weight: positives count negatives / positives times, from one aggregate."""
    r = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    up = (r["n"] - r["p"]) / r["p"] if r["p"] else 1.0
    return rows.withColumn("weight", F.when(F.col("label") == 1, float(up)).otherwise(1.0))


def stratified(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """fold 0..k-1, dealt in turn within each label by a hash of the keys: the same folds in any partitioning.

    Ranks come from counts of 65,536 hash ranges a label and the ranks inside them, so no label is sorted in one task.
    """
    h = F.xxhash64(*keys)
    full = rows.withColumns({"_h": h, "_b": F.shiftright(h, 48)})
    counts = full.groupBy("label", "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", *keys))
    out = full.join(counts.select("label", "_b", before.alias("_before")), ["label", "_b"]).withColumn("fold", ((F.col("_before") + rank - 1) % k).cast("int"))
    return out.select(*rows.columns, "fold")


def folds_for(rows: DataFrame, most: int = 5) -> int:
    r = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    return int(min(most, r["p"] or 0, (r["n"] or 0) - (r["p"] or 0)))


def out_of_fold(rows: DataFrame, kind: str, keys: list[str], most: int = 5, seed: int = 42, features=FEATURES, rounds: int | None = None, parallel: int = 4) -> DataFrame | None:
    """rows with fold and p, each scored by the learner fitted on the other folds; None where a class has under two rows.

    The folds are one column of one table, written once; `parallel` of them are fitted at a time.
    """
    k = folds_for(rows, most)
    if k < 2:
        return None
    full, columns = with_indicators(rows, features)
    parts = cut(stratified(full, keys, k))

    def one(i: int) -> DataFrame:
        model = estimator(kind, columns, seed, rounds).fit(weigh(parts.where(F.col("fold") != i)))
        return model.transform(weigh_one(parts.where(F.col("fold") == i))).select(*rows.columns, "fold", vector_to_array("probability")[1].alias("p"))

    with ThreadPool(min(parallel, k)) as pool:
        scored = pool.map(inheritable_thread_target(rows.sparkSession)(one), range(k))
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out


CV = "model_type string, n long, positives long, pos_rate double, cv_folds int, roc_auc double, accuracy double, brier double, error string"


def cross_validate(rows: DataFrame, kind: str, keys: list[str], **options) -> DataFrame:
    """One row (CV): metrics over all rows' out-of-fold scores together, or the error that a class has too few rows."""
    scored = out_of_fold(rows, kind, keys, **options)
    if scored is None:
        r = rows.agg(F.count("*"), F.sum("label")).first()
        n, pos = r[0], int(r[1] or 0)
        return rows.sparkSession.createDataFrame([(kind, n, pos, None, None, None, None, None, f"too few of a class for CV (pos={pos}, neg={n - pos})")], CV)
    s = cut(scored.select(F.lit(kind).alias("model_type"), F.col("label").cast("int").alias("y"), "p", "fold"))
    by = ["model_type"]
    folds = s.groupBy(*by).agg((F.max("fold") + 1).alias("cv_folds"))
    m = metrics.classification(s, by).join(metrics.roc_auc(s, by), by).join(folds, by)  # a row each
    r3 = lambda c: F.round(c, 3).alias(c)
    return m.select("model_type", "n", "positives", F.round(F.col("positives") / F.col("n"), 3).alias("pos_rate"), F.col("cv_folds").cast("int").alias("cv_folds"), r3("roc_auc"), r3("accuracy"), r3("brier"), F.lit(None).cast("string").alias("error"))


class Scorer:
    """A fitted learner with optional isotonic calibration and its provenance."""

    def __init__(self, model: PipelineModel, calibrator, columns: list[str], mode: str, kind: str, n: int):
        self.model, self.calibrator, self.columns, self.mode, self.kind, self.n = model, calibrator, columns, mode, kind, n

    def score(self, rows: DataFrame) -> DataFrame:
        """raw_score, calibrated_probability (clipped to [0, 1]), data_mode, model_type."""
        out = self.model.transform(weigh_one(with_indicators(rows)[0])).withColumn("raw_score", vector_to_array("probability")[1])
        if self.calibrator is not None:
            out = self.calibrator.transform(out.withColumn("iso", F.col("raw_score"))).withColumn("calibrated_probability", V.clip01(F.col("calibrated")))
        else:
            out = out.withColumn("calibrated_probability", V.clip01(F.col("raw_score")))
        return out.select(*rows.columns, "raw_score", "calibrated_probability", F.lit(self.mode).alias("data_mode"), F.lit(self.kind).alias("model_type"))

    def explain_gate(self, min_rows: int = 30) -> str:
        """'' if attributions may be shown, else why not: real data, a tree or linear model, and enough rows are asked for."""
        if self.mode != "real":
            return "synthetic model"
        if self.kind not in ("xgboost", "lightgbm", "forest", "logistic"):
            return "no exact attribution for this learner"
        return "" if self.n >= min_rows else f"fewer than {min_rows} training rows"


def weigh_one(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", F.lit(1.0))


def fit(rows: DataFrame, kind: str, keys: list[str], seed: int = 42, features=FEATURES, rounds: int | None = None) -> Scorer:
    """Fits on 70% and calibrates on a stratified 30% where there are 20 rows and both classes; else fits on all, uncalibrated."""
    full, columns = with_indicators(rows, features)
    r = full.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    n, p = r["n"], r["p"] or 0
    split = n >= 20 and 0 < p < n
    parts = cut(stratified(full, keys, 10) if split else full.withColumn("fold", F.lit(9)))
    model = estimator(kind, columns, seed, rounds).fit(weigh(parts.where("fold >= 3")))
    calibrator = None
    if split:
        held = model.transform(weigh_one(parts.where("fold < 3"))).withColumn("iso", vector_to_array("probability")[1]).select("iso", F.col("label").cast("double").alias("label"))
        calibrator = IsotonicRegression(featuresCol="iso", labelCol="label", predictionCol="calibrated").fit(held)
    return Scorer(model, calibrator, columns, data_mode(n), kind, n)


def synthetic(spark: SparkSession, n: int = 300, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Labelled rows from a documented logistic rule on trend, z, severity and concentration; the same for every partitioning.

    One row for each of ids(id), or for 0 to n - 1.
    """
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    normal = lambda k: F.sqrt(-2 * F.log(u(k) + 1e-12)) * F.cos(2 * math.pi * u(k + 50))
    rows = (spark.range(n) if ids is None else ids.select(F.col("id").cast("long").alias("id"))).withColumns({"price_latest": 100 + 20 * normal(1), "price_trend_4w": 8 * normal(2), "price_zscore_8w": normal(3), "signal_severity_mean_4w": 1 + 9 * u(4), "signal_count_4w": F.floor(20 * u(5)).cast("double"), "hhi_country": u(6)})
    z = 0.15 * F.col("price_trend_4w") + 0.9 * F.col("price_zscore_8w") + 0.3 * (F.col("signal_severity_mean_4w") - 5) + 1.2 * (F.col("hhi_country") - 0.5) - 0.4
    rows = rows.withColumn("label", (u(7) < V.sigmoid(z)).cast("int"))
    for c in FEATURES:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    return rows.select("id", *FEATURES, "label")
