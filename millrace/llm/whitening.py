"""Embedding whitening from an exact integer scatter.

Entries become integers x = floor(scale * c). The fit list is each distinct x vector once. Around an integer shift every task sums
entries and cross-products without rounding (64-bit blocks that cannot overflow, Python integers beyond); sums travel as 30-bit limbs
of their own rows, so Spark adds them as longs at any size. On the driver n * X'X - S S' is formed in integers, n**2 times the
covariance, and only then turned into floats and decomposed by eigh. What reaches the driver grows with the square of the dimension
(`max_dims`, 2048), not with the rows.

    deviation       sum over dimensions of (n * x - S)**2, exact; null beyond 64 bits, deviation_digits has it in full
    whitened        (x - S / n) on a component, over the root of its eigenvalue
    explained       the component's share of the trace
    identity_error  largest absolute entry of the fit list's whitened covariance minus the identity, measured on the whitened rows

Defined results: vectors null or holding a null or non-finite component are dropped; shorter vectors, empty ones included, count as if
they had zeros at their end; vec_id may be null or repeat, every remaining row gets its rows; repeated vectors enter the fit once and
are whitened each; entries of which scale * c passes 64 bits stand at its limits. A component whose eigenvalue is 0 (relative to the
largest, 1e-12) has whitened null and no part in identity_error; explained is null where all eigenvalues are 0, and so is
identity_error. Components are numbered by falling eigenvalue, equal ones in the order eigh gives; there are min(components,
dimensions) of them. Empty tables give no rows. Columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

LIMB = 30
_SAFE = 1 << 62


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists of one length as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches, dims: int, cells: int = 1 << 20):
    """Batches in slices of about `cells` entries."""
    step = max(1, cells // dims)
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _most(x: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of an integer matrix without rounding, as Python integers."""
    bound = _most(x) ** 2 * max(1, len(x))
    if bound < 1 << 53:
        f = x.astype(np.float64)  # every partial sum is a whole number of 53 bits, so the fast product is exact
        return x.sum(0).astype(object), (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(np.int64 if bound < _SAFE else object)
    return x.sum(0).astype(object), (x.T @ x).astype(object)


def _times(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exact."""
    wide = n * _most(x) + max(map(abs, s), default=0) >= _SAFE
    return x.astype(object if wide else np.int64) * n - np.array(s, object if wide else np.int64)


def _scatter(shift: list[int]):
    """mapInArrow body: this task's count, sums and cross-products around the shift, as limbs (place, limb, value)."""

    def run(batches):
        dims = len(shift)
        upper = np.triu_indices(dims)
        total = np.zeros(1 + dims + len(upper[0]), object)
        for b in _slices(batches, dims):
            s, c = _sums(_times(_matrix(b.column(0), dims), 1, shift))
            total[0] += b.num_rows
            total[1 : 1 + dims] += s
            total[1 + dims :] += c[upper]
        limbs = [(i, j, (-1 if v < 0 else 1) * ((abs(v) >> (LIMB * j)) & ((1 << LIMB) - 1))) for i, v in enumerate(map(int, total)) for j in range(-(-abs(v).bit_length() // LIMB))]
        if limbs:
            place, limb, value = zip(*limbs, strict=True)
            yield pa.record_batch([pa.array(place, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["place", "limb", "value"])

    return run


def scatter(fit: DataFrame, dims: int, shift: list[int]) -> tuple[int, list[int], np.ndarray]:
    """n, S and the integer matrix n * X'X - S S' of fit(x), exact."""
    parts = fit.select("x").mapInArrow(_scatter(shift), "place long, limb int, value long")
    total = [0] * (1 + dims + dims * (dims + 1) // 2)
    for r in parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect():  # about dims**2 rows
        total[r.place] += r.value << (LIMB * r.limb)
    n, s = total[0], np.array(total[1 : 1 + dims], object)
    c = np.zeros((dims, dims), object)
    c[np.triu_indices(dims)] = total[1 + dims :]
    c = np.triu(c) + np.triu(c, 1).T
    return n, [int(v) + n * m for v, m in zip(s, shift, strict=True)], n * c - np.outer(s, s)


class Whitening:
    """The projection: n, S, and the leading components scaled by the roots of their eigenvalues."""

    def __init__(self, n: int, s: list[int], m: np.ndarray, components: int):
        v = np.array([[int(x) / (n * n) for x in r] for r in m], np.float64)  # the only rounding: whole numbers to doubles
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        trace = sum(int(m[i, i]) for i in range(len(m))) / (n * n)
        self.n, self.s = n, s
        self.live = e > 1e-12 * max(e[0], 0) if len(e) else np.zeros(0, bool)
        self.project = u / np.sqrt(np.where(self.live, e, 1.0))
        self.explained = [float(x) / trace if trace > 0 else None for x in e]

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, and the whitened rows."""
        d = _times(x, self.n, self.s)
        return d, (d / self.n).astype(np.float64) @ self.project


def _spread(w: Whitening):
    """mapInArrow body: cross-products of this task's whitened rows, which are centred already."""

    def run(batches):
        k = w.project.shape[1]
        total = np.zeros((k, k))
        for b in _slices(batches, len(w.s)):
            y = w.apply(_matrix(b.column(0), len(w.s)))[1]
            total += y.T @ y
        i, j = np.indices((k, k))
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    got = fit.select("x").mapInArrow(_spread(w), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max((abs(r.v / w.n - (r.i == r.j)) for r in got if w.live[r.i] and w.live[r.j]), default=None)


def _whiten(w: Whitening, error: float | None):
    """mapInArrow body: a row for each vector and component."""

    def run(batches):
        k = len(w.explained)
        for b in _slices(batches, len(w.s)):
            d, y = w.apply(_matrix(b.column(1), len(w.s)))
            fits = _most(d) ** 2 * max(1, len(w.s)) < _SAFE
            squares = (d * d if fits else d.astype(object) ** 2).sum(1).tolist()
            own = [x if x < 1 << 63 else None for x in squares]
            names = np.repeat(np.arange(b.num_rows), k)
            dead = np.tile(~w.live, b.num_rows)
            wide = lambda v, t: pa.array(v, t).take(pa.array(names))
            yield pa.record_batch(
                [b.column(0).take(pa.array(names)), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(len(names), w.n)), wide(own, pa.int64()), wide(list(map(str, squares)), pa.string()),
                 pa.array(y.ravel(), mask=dead), pa.array(w.explained * b.num_rows, pa.float64()), pa.array([error] * len(names), pa.float64())],
                ["vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"])

    return run


OUT = "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, max_dims: int = 2048) -> DataFrame:
    """OUT for every vector of vectors(vec_id, embedding) that takes part; max_dims bounds what the driver decomposes."""
    spark = vectors.sparkSession
    data = integers(vectors, scale)
    dims = data.agg(F.max(F.size("x"))).first()[0]
    if not dims:  # no rows, or empty vectors only
        return spark.createDataFrame([], OUT)
    if dims > max_dims:
        raise ValueError(f"{dims} dimensions; max_dims is {max_dims}")
    data = data.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit = cut(data.select("x").distinct())
    few = np.array([r.x for r in fit.limit(64).collect()], np.float64)  # any shift gives the same result; one amid the rows keeps numbers small
    n, s, m = scatter(fit, dims, [int(v) for v in np.rint(few.mean(0))])
    w = Whitening(n, s, m, min(components, dims))
    return data.mapInArrow(_whiten(w, identity_error(fit, w)), OUT)
