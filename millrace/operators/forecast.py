"""Forecasting: closed-form trend with interval, Holt's linear trend, orchestration and hold-out benchmark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.schemas import DISAGREEMENT_GATE, HORIZONS, MIN_POINTS

Z90 = 1.2815515655446004


def horizons() -> Column:
    return F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(w).alias("weeks")) for k, w in HORIZONS.items()))


def trend(weekly: DataFrame, key: str = "resource_id") -> DataFrame:
    """key, horizon, point, lower, upper: least-squares line over observed weeks with an 80% band of +- z * residual deviation."""
    i = (F.row_number().over(Window.partitionBy(key).orderBy("week")) - 1).cast("double")
    s = weekly.withColumn("x", i).groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("cut"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.count("y").alias("n"))
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0))) / F.nullif(F.col("n") - 2, F.lit(0)))
    rows = s.withColumns({"sigma": sigma, "h": F.explode(horizons())})
    point = F.col("cut") + F.col("slope") * (F.col("n") - 1 + F.col("h.weeks"))
    return rows.select(key, "h.horizon", "n", point.alias("point"), (point - Z90 * F.col("sigma")).alias("lower"), (point + Z90 * F.col("sigma")).alias("upper"))


CHANGES, EARLY, SCALE = 25, 0.8, 0.05  # changepoints, the share of the history they lie in, the scale of slope changes


def lasso(g: np.ndarray, c: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """The b that minimises b'gb / 2 - c'b + penalty * |b|_1, by search over signs: each step is one linear solve, the end is exact."""
    b = np.zeros(len(c)) if start is None else start.copy()
    sign = np.sign(b)
    for _ in range(50 * len(c) + 50):
        slope = g @ b - c
        on = np.flatnonzero(sign)
        if not len(on) or np.abs(slope[on] + penalty * sign[on]).max() < 1e-10 * (1 + penalty):  # at rest: who else has to move?
            off = np.flatnonzero(sign == 0)
            over = np.abs(slope[off]) - penalty
            if not len(off) or over.max() <= 1e-10 * (1 + penalty):
                return b
            j = off[over.argmax()]
            sign[j] = -np.sign(slope[j])
            on = np.flatnonzero(sign)
        aim = np.zeros(len(c))
        aim[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on] - penalty * sign[on], rcond=None)[0]
        turned = on[aim[on] * sign[on] < 0]
        share = np.append(b[turned] / (b[turned] - aim[turned]), 1.0)  # how far until one reaches 0
        first = share.argmin()
        b = b + share[first] * (aim - b)
        if first < len(turned):
            b[turned[first]] = 0.0
        sign = np.where(b == 0, 0.0, np.sign(b))
    return b


class PiecewiseTrend:
    """A line whose slope may change at points fixed in advance, at a price for every change: the mode of a model with normal errors
    and Laplace slope changes of scale SCALE, on a time axis of length 1 and values scaled by their largest. The error's variance and
    the changes are fitted in turn, which only lowers the objective."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x0, self.span = x[0], x[-1] - x[0]
        self.unit = np.abs(y).max() or 1.0
        t, v = (x - self.x0) / self.span, y / self.unit
        early = int(np.floor(len(x) * EARLY))
        self.at = t[np.unique(np.linspace(0, early - 1, min(CHANGES, max(0, early - 1)) + 1).round().astype(int))[1:]] if early > 1 else t[:0]
        line = np.stack([np.ones_like(t), t], 1)
        q = np.linalg.qr(line)[0]
        h = np.maximum(t[:, None] - self.at, 0)
        rest, own = h - q @ (q.T @ h), v - q @ (q.T @ v)
        g, c = rest.T @ rest, rest.T @ own
        self.change = np.zeros(len(self.at))
        self.variance = max(float(own @ own) / len(v), 1e-10)
        for _ in range(200):
            self.penalty = self.variance / SCALE
            self.change = lasso(g, c, self.penalty, self.change)
            left = own - rest @ self.change
            now = max(float(left @ left) / len(v), 1e-10)
            done = abs(now - self.variance) <= 1e-9 * self.variance
            self.variance = now
            if done:
                break
        self.level, self.slope = np.linalg.lstsq(line, v - h @ self.change, rcond=None)[0]

    def at_week(self, x: float) -> tuple[float, float]:
        """Point, and the deviation of what may come: error, and slope changes as many and as large as those seen."""
        t = (x - self.x0) / self.span
        point = self.level + self.slope * t + float(np.maximum(t - self.at, 0) @ self.change)
        size = float(np.abs(self.change).mean()) if len(self.change) else 0.0
        ahead = max(0.0, t - 1.0)
        return point * self.unit, float(np.sqrt(self.variance + len(self.at) * 2 * size**2 * ahead**3 / 3)) * self.unit


def changepoint_trend(weekly: DataFrame, key: str = "resource_id") -> DataFrame:
    """The columns of `trend` from a trend whose slope may change; weeks count by the calendar. NULL under three weeks.

    The band is normal, of 80%; a series is at most a few thousand weeks, so it fits a task, which takes many of them in turn.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["y"]).sort_values("week")
        out = {h: (None, None) for h in HORIZONS}
        if len(pdf) > 2:
            x = np.array([d.toordinal() / 7 for d in pdf.week])
            model = PiecewiseTrend(x, pdf.y.to_numpy(float))
            out = {h: model.at_week(x[-1] + w) for h, w in HORIZONS.items()}
        rows = [(h, len(pdf), p, None if p is None else p - Z90 * s, None if p is None else p + Z90 * s) for h, (p, s) in out.items()]
        return pd.DataFrame(rows, columns=["horizon", "n", "point", "lower", "upper"])

    kind = dict(weekly.dtypes)[key]
    run = lambda name, pdf: fit(pdf).assign(**{key: name[0]})[[key, "horizon", "n", "point", "lower", "upper"]]
    return weekly.select(key, "week", "y").groupBy(key).applyInPandas(run, f"`{key}` {kind}, horizon string, n long, point double, lower double, upper double")


def holt_fit(y: np.ndarray, steps: int, grid: int = 12) -> np.ndarray:
    """Holt's additive trend; both weights by squared one-step error on a grid, all grid points at once, then one refinement."""
    def run(a, b):
        level, slope = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0])
        err = np.zeros(len(a))
        for v in y[1:]:
            f = level + slope
            err += (v - f) ** 2
            new = f + a * (v - f)
            slope = slope + b * a * (v - f)
            level = new
        return err, level, slope

    lo, hi = np.array([0.01, 0.0]), np.array([0.99, 1.0])
    for _ in range(2):
        a, b = (g.reshape(-1) for g in np.meshgrid(np.linspace(lo[0], hi[0], grid), np.linspace(lo[1], hi[1], grid), indexing="ij"))
        err, level, slope = run(a, b)
        k = int(np.argmin(err))
        span = (hi - lo) / grid
        lo, hi = np.maximum([a[k], b[k]] - span, [0.001, 0]), np.minimum([a[k], b[k]] + span, [0.999, 1])
    return level[k] + slope[k] * np.arange(1, steps + 1)


def holt(weekly: DataFrame, key: str = "resource_id") -> DataFrame:
    """key, horizon, holt_winters_point per series (a series is at most a few thousand weeks, so it fits one task)."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("week").y.to_numpy(float)
        f = holt_fit(y, max(HORIZONS.values())) if len(y) > 1 else None
        return pd.DataFrame({key: pdf[key].iloc[0], "horizon": list(HORIZONS), "holt_winters_point": [None if f is None else float(f[w - 1]) for w in HORIZONS.values()]})

    return weekly.select(key, "week", "y").groupBy(key).applyInPandas(fit, f"{key} string, horizon string, holt_winters_point double")


def external(weekly: DataFrame, fn: Callable[[pd.DataFrame, dict[str, int]], dict[str, float]], name: str, key: str = "resource_id") -> DataFrame:
    """An injected forecaster, optional: a series it fails on gets NULL points, never an error."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            got = fn(pdf.sort_values("week")[["week", "y"]], HORIZONS)
        except Exception:
            got = {}
        return pd.DataFrame({key: pdf[key].iloc[0], "horizon": list(HORIZONS), name: [got.get(h) for h in HORIZONS]})

    return weekly.select(key, "week", "y").groupBy(key).applyInPandas(fit, f"{key} string, horizon string, {name} double")


def forecast_rows(weekly: DataFrame, second: DataFrame, third: DataFrame | None = None, key: str = "resource_id", first: Callable[[DataFrame, str], DataFrame] = trend) -> DataFrame:
    """The status machine (first: `trend` or `changepoint_trend`): short series give one sentinel row (horizon 'all'), a missing model gives model_error, wide disagreement is flagged."""
    count = weekly.groupBy(key).agg(F.count("y").alias("n"))
    short = count.where(F.col("n") < MIN_POINTS).select(key, F.lit("all").alias("horizon"), *(F.lit(None).cast("double").alias(c) for c in ("prophet_point", "prophet_lower", "prophet_upper", "holt_winters_point", "chronos_point", "disagreement_pct")), F.lit("insufficient_data").alias("status"), F.format_string(f"%d weekly points < {MIN_POINTS}", "n").alias("notes"))
    t = first(weekly, key).where(F.col("n") >= MIN_POINTS).join(second, [key, "horizon"], "left")
    t = t.join(third, [key, "horizon"], "left") if third is not None else t.withColumn("chronos_point", F.lit(None).cast("double"))
    d = V.disagreement(F.col("point"), F.col("holt_winters_point"))
    c = V.disagreement(F.col("point"), F.col("chronos_point"))
    status = F.when(F.col("point").isNull() | F.col("holt_winters_point").isNull(), "model_error").when(d > DISAGREEMENT_GATE, "unstable_disagreement").otherwise("ok")
    rows = t.select(key, "horizon", F.col("point").alias("prophet_point"), F.col("lower").alias("prophet_lower"), F.col("upper").alias("prophet_upper"), "holt_winters_point", "chronos_point", F.round(d, 2).alias("disagreement_pct"), status.alias("status"), F.when(c > DISAGREEMENT_GATE, F.format_string("chronos diverges from prophet by %.0f%%", c)).alias("notes"))
    return rows.unionByName(short)


def holdout(weekly: DataFrame, weeks: int = 8, key: str = "resource_id") -> DataFrame:
    """Adds part: the last `weeks` observed weeks of each series are the test."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("week")))
    return weekly.withColumn("part", F.when(r <= weeks, "test").otherwise("train"))


def collapse_status(rows: DataFrame, by: list[str], priority: tuple[str, ...]) -> DataFrame:
    """Worst status per group by priority; unknown ones last, the smallest of them."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("status"))
    return rows.groupBy(*by).agg(F.min_by("status", F.struct(F.when(rank == 0, 99).otherwise(rank), "status")).alias("status"))
