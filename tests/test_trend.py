"""The trend with changepoints: optimal by its conditions, and better than a line where the slope has changed."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forecast, metrics
from millrace.schemas import HORIZONS

MONDAY = dt.date(2021, 1, 4)


def brute_lasso(g, c, penalty):
    """Every pattern of signs solved, the best valid one kept."""
    best, at = 0.0, np.zeros(len(c))
    for signs in itertools.product((-1, 0, 1), repeat=len(c)):
        s = np.array(signs, float)
        on = np.flatnonzero(s)
        if len(on):
            b = np.zeros(len(c))
            b[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on] - penalty * s[on], rcond=None)[0]
            if (b[on] * s[on] >= 0).all():
                value = b @ g @ b / 2 - c @ b + penalty * np.abs(b).sum()
                if value < best:
                    best, at = value, b
    return at


def test_lasso_equals_all_sign_patterns():
    r = np.random.default_rng(1)
    for _ in range(40):
        x = np.cumsum(r.normal(size=(30, 5)), 0)
        y = r.normal(size=30) * 3 + x @ (r.normal(size=5) * (r.random(5) < 0.5))
        g, c = x.T @ x, x.T @ y
        penalty = float(np.abs(c).max() * r.random())
        assert np.allclose(forecast.lasso(g, c, penalty), brute_lasso(g, c, penalty), atol=1e-7)


@pytest.mark.parametrize("seed", range(4))
def test_fit_meets_the_conditions_of_the_optimum(seed):
    r = np.random.default_rng(seed)
    x = np.arange(120.0)
    y = 50 + 0.2 * x + np.maximum(x - 60, 0) * (-0.7) + r.normal(size=120)
    m = forecast.PiecewiseTrend(x, y)
    t = x / 119
    h = np.maximum(t[:, None] - m.at, 0)
    left = y / m.unit - m.level - m.slope * t - h @ m.change
    assert abs(left.sum()) < 1e-8 and abs(left @ t) < 1e-8
    pull = h.T @ left
    moved = m.change != 0
    assert np.allclose(pull[moved], m.penalty * np.sign(m.change[moved]), atol=1e-6) and (np.abs(pull) <= m.penalty + 1e-6).all() and 0 < moved.sum() < 15
    assert m.variance == pytest.approx(left @ left / 120, rel=1e-6) and m.penalty == pytest.approx(m.variance / forecast.SCALE, rel=1e-5)


def test_kinked_series_are_forecast_better_than_by_a_line(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(6):
        for i in range(150):
            rows.append((f"s{k}", MONDAY + dt.timedelta(weeks=i), float(100 + 0.5 * i - 1.2 * max(0, i - 70 - 5 * k) + r.normal())))
    w = forecast.holdout(spark.createDataFrame(rows, "resource_id string, week date, y double"), 13)
    train, test = w.where("part = 'train'").drop("part"), w.where("part = 'test'")
    end = train.groupBy("resource_id").agg(F.max("week").alias("end"))
    actual = test.join(end, "resource_id").select("resource_id", (F.datediff("week", "end") / 7).cast("int").alias("weeks"), F.col("y").alias("actual"))
    weeks = F.element_at(F.create_map(*(F.lit(x) for kv in HORIZONS.items() for x in kv)), F.col("horizon"))
    both = [f(train).select("resource_id", F.lit(name).alias("model"), F.col("point").alias("predicted"), "lower", "upper", weeks.alias("weeks")) for name, f in (("line", forecast.trend), ("changes", forecast.changepoint_trend))]
    met = both[0].unionByName(both[1]).join(actual, ["resource_id", "weeks"])
    errors = {e.model: e.mae for e in metrics.forecast_errors(met, "resource_id").collect()}
    assert errors["changes"] < 0.25 * errors["line"]
    assert met.where("model = 'changes' and actual between lower and upper").count() >= 12


def test_short_flat_and_gapped_series(spark):
    rows = [("flat", MONDAY + dt.timedelta(weeks=i), 5.0) for i in range(20)] + [("two", MONDAY + dt.timedelta(weeks=i), 1.0 * i) for i in range(2)] + [("gap", MONDAY + dt.timedelta(weeks=i), 2.0 * i) for i in (*range(10), *range(30, 40))] + [("nul", MONDAY, None)]
    got = {(r.resource_id, r.horizon): r for r in forecast.changepoint_trend(spark.createDataFrame(rows, "resource_id string, week date, y double")).collect()}
    assert len(got) == 16 and got["two", "1m"].point is None and got["nul", "1m"].n == 0
    assert got["flat", "6m"].point == pytest.approx(5.0, abs=1e-3) and got["gap", "1m"].point == pytest.approx(86.0, abs=0.1)
    assert all(r.lower <= r.point <= r.upper for r in got.values() if r.point is not None)
