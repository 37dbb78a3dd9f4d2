"""Connected components and minimum spanning forests as joins and grouped minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import cut, drop

HELD = 1_000_000  # ids that a task keeps while it thins edges out


class Union:
    """Sets of ids, each named by its least one."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x, y) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True


def _stars(batches):
    """A task's edges as edges to the least id of each tree: as connected, at most one an id."""
    def out(sets: Union):
        ids = [x for x in sets.up if sets.find(x) != x]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([sets.find(x) for x in ids], pa.int64())], ["u", "v"])

    sets = Union()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(x, y)
        if len(sets.up) > HELD:
            yield out(sets)
            sets = Union()
    if sets.up:
        yield out(sets)


def connected_components(edges: DataFrame, most: int = 60, alone: int = 0) -> DataFrame:
    """edges(a, b) of longs -> (id, component), the least id reachable, for every id on an edge with another one.

    Every id points at a smaller one of its component (u > v). In a round all that point at an id, and the id, learn the least id among
    them; tasks thin their edges out before each shuffle, and only minima travel. Hubs of any degree cost rows, not memory. Up to `alone`
    edges (HELD / 2 at most) that are left when each task has thinned out its own are joined by one task.
    """
    thin = lambda e: e.mapInArrow(_stars, "u long, v long")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
    e = cut(thin(edges.select("a", "b").where("a <> b")).distinct())
    was = mark(e)
    if was[0] <= min(alone, HELD // 2):
        one = cut(thin(e.coalesce(1)))
        return one.toDF("id", "component").union(one.select("v", F.col("v").alias("w")).distinct())
    for _ in range(most):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = thin(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        new = cut(met.select("u", F.col("m").alias("v")).union(met.select("v", "m").toDF("u", "v")).where("u > v").distinct())
        drop(e)
        e, now = new, mark(new)
        if now == was:
            roots = e.select("v").distinct()
            return e.toDF("id", "component").union(roots.select("v", F.col("v").alias("w")))
        was = now
    raise RuntimeError("components did not settle")


def _lightest(a: np.ndarray, b: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, each between x and y, ties by (w, a, b): Boruvka on arrays."""
    order = np.lexsort((b, a, w))
    ids, ends = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    x, y, live, every, taken = ends[:len(order)], ends[len(order):], np.arange(len(order)), np.arange(len(ids)), []
    while True:
        apart = x != y
        x, y, live = x[apart], y[apart], live[apart]
        if not len(live):
            return order[np.concatenate(taken)] if taken else order[:0]
        best, other = np.full(len(ids), len(order)), np.full(len(ids), len(order))
        best[x[::-1]], other[y[::-1]] = live[::-1], live[::-1]  # of those that meet the last one written stays, the lightest
        best = np.minimum(best, other)
        some = np.flatnonzero(best < len(order))
        at = np.searchsorted(live, best[some])
        taken.append(np.unique(best[some]))
        up = every.copy()
        up[some] = x[at] + y[at] - some
        up = np.where((up[up] == every) & (every < up), every, up)
        while not np.array_equal(up, up[up]):
            up = up[up]
        x, y = up[x], up[y]


def _light(t: pa.Table) -> pa.Table:
    columns = [c.to_numpy() for c in t.columns]
    return t.take(pa.array(_lightest(*columns, *columns[:2]) if len(columns) == 3 else _lightest(*columns)))


def _thin_by_weight(batches):
    """A task's edges (a, b, w, x, y) without those that close a cycle of lighter ones, each joining x and y, in portions of HELD rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > HELD:
            t = _light(pa.Table.from_batches(held))
            held, n = t.to_batches(), t.num_rows
            if n > HELD // 2:
                yield from held
                held, n = [], 0
    if n:
        yield from _light(pa.Table.from_batches(held)).to_batches()


def thinned(edges: pa.Table) -> pa.Table:
    """The edges (a, b, w) of one task that may be in a minimum spanning forest of all, ties by (w, least end, greatest end)."""
    a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
    t = pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), edges["w"]], ["a", "b", "w"])
    return _light(t).cast(edges.schema)


def spanning_forest(edges: DataFrame, most: int = 60, alone: int = HELD) -> DataFrame:
    """edges(a, b, w) -> those of a minimum spanning forest, ties by (w, a, b). Boruvka: in each round every component takes its lightest
    way out, and what these join becomes one; the number of components at least halves. The last `alone` edges are one task's."""
    thin = lambda e: e.mapInArrow(_thin_by_weight, "a long, b long, w double, x long, y long")
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b")
    live = cut(thin(e.withColumns({"x": F.col("a"), "y": F.col("b")})).distinct())  # x, y: the components of a, b
    taken = None
    for _ in range(most):
        if live.count() <= alone:
            mine = cut(thin(live.coalesce(1)).select("a", "b", "w"))
            return mine if taken is None else taken.union(mine)
        way = F.struct("w", "a", "b", "x", "y")
        out = live.select("x", way.alias("e")).union(live.select("y", way)).groupBy("x").agg(F.min("e").alias("e"))
        took = cut(out.select("e.*").distinct())
        mine = took.select("a", "b", "w")
        taken = mine if taken is None else taken.union(mine)
        of = connected_components(took.select(F.col("x").alias("a"), F.col("y").alias("b")), alone=alone // 2)
        x, y = of.toDF("x", "cx"), of.toDF("y", "cy")
        moved = live.join(x, "x", "left").join(y, "y", "left").select("a", "b", "w", F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y")
        live = cut(thin(moved))
    raise RuntimeError("spanning forest did not settle")
