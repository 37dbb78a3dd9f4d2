"""Vector and scalar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    n = norm(a)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pct_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now / before - 1) * 100)


def disagreement(p: Column, h: Column) -> Column:
    return F.abs(p - h) / F.greatest(F.abs(p), F.abs(h), F.lit(1e-9)) * 100


def hhi(shares: Column) -> Column:
    """Herfindahl index of an array of shares, 4 decimals; NULL without shares."""
    return F.when(F.size(shares) > 0, F.round(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4))


def risk_tier(p: Column, tiers) -> Column:
    out = F.when(p.isNull() | F.isnan(p), "Not scored")
    for limit, name in tiers:
        out = out.when(p < limit, name)
    return out.otherwise("Critical")
