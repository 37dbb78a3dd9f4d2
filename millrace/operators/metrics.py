"""Model evaluation as aggregates: rows carry (group columns), y (0/1) and p."""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def classification(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), brier, n, positives, in one pass."""
    hat = (F.col("p") >= threshold).cast("int")
    tp, fp, fn, tn = (F.sum(((hat == a) & (F.col("y") == b)).cast("long")) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
    s = rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "n": F.expr("tp + fp + fn + tn"), "positives": F.expr("tp + fn")})
    return s.select(*by, "n", "positives", "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "brier")


def in_ranges(rows: DataFrame, by: list[str], order: str, ranges: int = RANGES, descending: bool = False) -> DataFrame:
    """Adds _range: `ranges` consecutive ranges of a number, about equally full over all rows, counted in the order asked for.

    Rows of one value share a range. Their bounds come from one pass of approximate quantiles; any bounds give the same sums.
    """
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    inner = sorted({c for c in cuts or [] if c == c and abs(c) != float("inf")})
    if not inner:
        return rows.withColumn("_range", F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_v", outputCol="_range", handleInvalid="keep")
    out = cut.transform(rows.withColumn("_v", F.col(order).cast("double"))).drop("_v")
    last = (1 << 31) - 1
    place = (-F.col("_range") if descending else F.col("_range")).cast("int")
    return out.withColumn("_range", F.coalesce(place, F.lit(last if descending else -last)))  # nulls stand where an ORDER BY puts them


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums, rows(by, _range, ...) in `order` within `by`, by ranges: sums maps a new column to the column it adds up, the row
    itself included; all_<new> is the total. Ranges are added up first (a row a range and group), then carried into each range's own
    window, so a group of any size is spread over as many tasks as it has ranges."""
    per = rows.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    whole = Window.partitionBy(*by)
    ahead = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*by, "_range", *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.sum(f"_{n}").over(whole).alias(f"all_{n}") for n in sums))
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.alias("r").join(carried.alias("c"), [F.col(f"r.`{b}`").eqNullSafe(F.col(f"c.`{b}`")) for b in [*by, "_range"]])
    out = out.select("r.*", *(F.col(f"c.{p}{n}") for n in sums for p in ("_before_", "all_")))
    return out.withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(own) for n, c in sums.items()}).drop(*(f"_before_{n}" for n in sums), "_range")


def _steps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative tp, fp per distinct score, high to low, and the totals. Equal scores are folded first."""
    g = rows.groupBy(*by, "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    s = running(in_ranges(g, by, "p", descending=True), by, [F.desc("p")], {"tp": "pos", "fp": "neg"})
    return s.withColumnsRenamed({"all_tp": "all_pos", "all_fp": "all_neg"})


def roc_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney with mid-ranks; NULL with one class only. pr_auc is average precision, ties grouped."""
    s = _steps(rows, by)
    area = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2)) / F.when(F.min("all_pos") * F.min("all_neg") > 0, F.min("all_pos") * F.min("all_neg"))

    return s.where("all_pos > 0 or all_neg > 0").groupBy(*by).agg(area.alias("roc_auc"), F.when(F.min("all_pos") > 0, F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))).alias("pr_auc"))


def curve_points(rows: DataFrame, by: list[str]) -> DataFrame:
    """threshold, tpr, fpr, precision, recall per distinct score."""
    s = _steps(rows, by)
    return s.select(*by, F.col("p").alias("threshold"), F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))


def confusion(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """n for each of the four (y, predicted) cells, empty ones included."""
    cell = F.struct(F.col("y").cast("int").alias("y"), (F.col("p") >= threshold).cast("int").alias("predicted"))
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    sums = rows.groupBy(*by).agg(*(F.sum(((cell.y == a) & (cell.predicted == b)).cast("long")).alias(f"c{a}{b}") for a, b in cells))
    out = F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a, b in cells))
    return sums.select(*by, F.explode(out).alias("c")).select(*by, "c.y", "c.predicted", "c.n")


def reliability(rows: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """bin, mean_p, rate, n over equal bins of [0, 1]; empty bins are absent."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.count("*").alias("n"))


def forecast_errors(rows: DataFrame, group: str, model: str = "model") -> DataFrame:
    """rows(group, model, actual, predicted) -> per model the mean over groups of MAE and of MAPE (zero actuals left out)."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    per = rows.groupBy(group, model).agg(F.avg(e).alias("mae"), (F.avg(F.when(F.col("actual") != 0, e / F.abs("actual"))) * 100).alias("mape"))
    return per.groupBy(model).agg(F.avg("mae").alias("mae"), F.avg("mape").alias("mape"), F.count("*").alias("groups"))


def exact_means(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The mean of each column's known values, rounded once: no matter how rows are ordered or dealt, at any magnitude.

    A double is a whole number of at most 55 bits times a power of two; whole numbers are added up by power, in two halves that cannot
    overflow, and meet as fractions on the driver (some 2,000 powers a column at most). What lies under 2**-1000 is cut off.
    """
    x = F.col("x")
    power = F.greatest(F.floor(F.log2(F.abs(x))) - 54, F.lit(-1000))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    one = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)))).alias("v")).select("v.*").where("x is not null")
    split = one.select("c", F.when(x == 0, F.lit(0)).when(finite, power).alias("e"), x).withColumn("m", F.when(F.col("e").isNotNull(), (x * F.pow(F.lit(2.0), -(F.col("e") + F.when(F.col("e") < -900, F.lit(100)).otherwise(0))) * F.when(F.col("e") < -900, F.lit(2.0**100)).otherwise(1.0)).cast("long")))
    sums = split.groupBy("c", "e").agg(F.count("*").alias("n"), F.sum(F.shiftright("m", 28)).alias("high"), F.sum(F.col("m").bitwiseAND((1 << 28) - 1)).alias("low"), F.sum("x").alias("plain")).collect()
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        mine = [r for r in sums if r.c == i]
        n = sum(r.n for r in mine)
        if any(r.e is None for r in mine):  # NaN and infinities as in any sum
            out[c] = sum(r.plain for r in mine) / n
        else:
            out[c] = float(sum((Fraction((r.high << 28) + r.low) * Fraction(2) ** r.e for r in mine), Fraction(0)) / n) if n else None
    return out


def contributions(columns: dict[str, float], means: dict[str, float | None]) -> dict[str, Column]:
    """Exact attribution of a linear model: weight * (value - mean)."""
    return {c: F.lit(float(w)) * (F.col(c) - F.lit(means[c]).cast("double")) for c, w in columns.items()}


def linear_attribution(rows: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Exact attribution of a linear model: weight * (value - mean over rows), one row per key and feature."""
    parts = contributions(weights, exact_means(rows, list(weights)))
    out = F.array(*(F.struct(F.lit(c).alias("feature"), p.alias("contribution")) for c, p in parts.items()))
    return rows.select(*keys, F.explode(out).alias("a")).select(*keys, "a.feature", "a.contribution")


def top_drivers(attributions: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k features of largest absolute contribution per group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("contribution")), "feature")
    return attributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def importance(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def top_importances(importances: DataFrame, k: int = 6, above: float = 1e-6) -> DataFrame:
    """The k features of highest importance over `above`, equal ones by name."""
    return importances.where(F.col("importance") > above).orderBy(F.desc("importance"), "feature").limit(k)
