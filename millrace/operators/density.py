"""Hierarchical density clustering of vectors: what is denser than its surroundings for longest, at every scale at once.

1. Equal vectors are folded into one point with a count. Core distance: to the `min_samples`-th nearest other row.
2. Mutual reachability of two points is max(their distance, both core distances). The minimum spanning tree under it: the tree of every
   two pages of vectors (`blocks`) is found by itself, and what none of them holds is in no minimum tree of the whole; the edges left
   are few for each point and are joined by Boruvka rounds. Cells that lie farther apart than the longest edge of some spanning tree
   never meet.
3. The tree is contracted from short edges to long ones, in levels: a level takes edges up to a length at which every component is small
   enough for one task (PART edges). A component needs no more than its size, the cluster open in it (how long its points have stayed)
   and the best stability below; only the clusters closed and the points that joined one go on. Edges of one length join at once, so
   results don't depend on how ties are ordered; should one length alone join more than PART edges, grouped sums join them instead.
4. A cluster is kept if its stability is at least the sum of the best below it, unless one above it is kept; the one of all rows never is.

Distances are Euclidean between unit vectors. Distances under NEAR count as NEAR, so copies have a finite density.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import graph
from millrace.operators.blocks import SAMPLE_CELLS, TILE, Blocks, matrix, usable
from millrace.shared import cut, drop

NEAR = 1e-9
PART = 100_000
FEW = 4096  # rows whose tree is found without landmarks
LANDMARKS = 1 << 16
DENSE = 16  # edges for each row of two pages


def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ v.T), 0))


def _angle(distance: np.ndarray | float) -> np.ndarray:
    """The angle between unit vectors at that distance; pi where there is no bound."""
    return 2 * np.arcsin(np.clip(np.asarray(distance, float) / 2, 0, 1))


def core_distances(blocks: Blocks, k: int) -> DataFrame:
    """(id, core): distance to the k-th nearest other row, a point's own copies among them; null where there are fewer rows."""
    dims = blocks.dims

    def task(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        u, v = matrix(x["v"], dims), matrix(y["v"], dims)
        d = _distances(u, v)
        if same:
            np.fill_diagonal(d, np.inf)
        out = []
        for mine, other, m in ((x, y, d), (y, x, d.T)) if not same else ((x, y, d),):
            if m.size:
                near = np.argsort(m, 1)[:, :k]
                i, j = np.repeat(np.arange(len(m)), near.shape[1]), near.ravel()
                i, j = i[np.isfinite(m[i, j])], j[np.isfinite(m[i, j])]
                p, q = (u, v) if mine is x else (v, u)
                out.append(pa.table([mine["id"].take(pa.array(i)), pa.array(np.sqrt(((p[i] - q[j]) ** 2).sum(1))), other["copies"].take(pa.array(j))], ["id", "d", "n"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["id", "d", "n"])

    def nearest(found: DataFrame) -> DataFrame:
        own = blocks.rows.where("copies > 1").select("id", F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("n"))
        w = Window.partitionBy("id").orderBy("d")
        few = found.union(own).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        met = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return few.withColumn("met", met).groupBy("id").agg(F.min(F.when(F.col("met") >= k, F.col("d"))).alias("core"))

    ddl = "id long, d double, n long"
    own = [(i, i) for i, n in enumerate(blocks.count) if n]
    first = cut(blocks.meet(own, task, ddl))
    reach = np.zeros(len(blocks.count))
    for r in blocks.rows.join(nearest(first), "id", "left").groupBy("cell").agg(F.max(F.coalesce("core", F.lit(4.0))).alias("most")).collect():  # a row a cell
        reach[r.cell] = r.most
    later = [p for p in blocks.pairs(_angle(reach)) if p[0] != p[1]]
    return nearest(first.union(cut(blocks.meet(later, task, ddl))) if later else first)


def _tree(v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prim's tree of the complete graph: both ends of each edge."""
    n = len(v)
    best, frm, out = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        out[at] = True
        d = np.maximum(np.maximum(np.sqrt(np.maximum(2 - 2 * (v @ v[at]), 0)), core), core[at])
        closer = (d < best) & ~out
        best[closer], frm[closer] = d[closer], at
        at = int(np.where(out, np.inf, best).argmin())
        a.append(int(frm[at]))
        b.append(at)
    return np.array(a, np.int64), np.array(b, np.int64)


def _lengths(u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """Mutual reachability, row by row; the same number whenever the same two rows meet."""
    return np.maximum(np.maximum(np.sqrt(((u - v) ** 2).sum(1)), np.maximum(cu, cv)), NEAR)


def _edge_table(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], ["a", "b", "w"])


class Order:
    """The points of a tree in an order in which every component, whatever the length it is cut at, is a range. The longest edge on the way
    between two points is then the longest gap between their places."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        sets, after, last, gap = graph.Union(), [-1] * n, list(range(n)), [0.0] * n  # first of a range is its name in `first`
        first = list(range(n))
        for i in np.argsort(w, kind="stable").tolist():
            x, y = sets.find(int(a[i])), sets.find(int(b[i]))
            sets.join(x, y)
            after[last[x]], gap[last[x]] = first[y], float(w[i])
            root = min(x, y)
            first[root], last[root] = first[x], last[y]
        at, self.place, self.gaps = first[sets.find(0)], np.zeros(n, np.int64), [np.zeros(n)]
        for i in range(n):
            self.place[at], self.gaps[0][i] = i, gap[at]
            at = after[at]
        while (step := 1 << len(self.gaps)) < n:  # longest of 2, 4, 8, ... gaps from each place on
            was = self.gaps[-1]
            self.gaps.append(np.maximum(was, np.append(was[step // 2:], np.zeros(step // 2))))
        self.gaps = np.stack(self.gaps)

    def longest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest edge on the way between the points at these places, 0 from a point to itself."""
        low, n = np.minimum(i, j), np.abs(i - j)
        k = np.frexp(np.maximum(n, 1))[1] - 1
        return np.where(n > 0, np.maximum(self.gaps[k, low], self.gaps[k, np.maximum(low, low + n - (1 << k))]), 0.0)


class Page:
    """A page's rows as arrays: place, that of the nearest landmark; away, the way to it; hub, the place that most rows reach by short edges."""

    def __init__(self, t: pa.Table, dims: int, order: Order):
        self.ids, self.v, self.core = t["id"].to_numpy(), matrix(t["v"], dims), t["core"].to_numpy()
        self.place, self.away = t["place"].to_numpy(), t["away"].to_numpy()
        self.near = self.v.astype(np.float32)
        some = np.unique(np.sort(self.place)[np.linspace(0, len(self.place) - 1, 32).astype(int)])
        self.hub = some[order.longest(some[:, None], self.place[None, :]).mean(1).argmin()]


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few that are true, eight looked at together."""
    whole = len(flags) // 8 * 8
    at = (np.flatnonzero(flags[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flags[at]], np.flatnonzero(flags[whole:]) + whole])


def _shorter(x: Page, y: Page, same: bool, order: Order, slack: float) -> pa.Table:
    """Edges between two pages that are shorter than the way between their ends over landmarks; where these are many, their tree."""
    ways = [[np.maximum(p.away, order.longest(p.place, hub)) for p in (x, y)] for hub in {int(x.hub), int(y.hub)}]
    wx, wy = min(ways, key=lambda w: w[0].sum() + w[1].sum())  # the way to the hub and on is as long as the longer part at most
    cosine = lambda w: 1 - w * w / 2 - slack
    s = x.near @ y.near.T
    lx, ly = cosine(wx).astype(np.float32), cosine(wy).astype(np.float32)
    some = s >= lx[:, None]
    some |= s >= ly
    i, j = np.divmod(_true(some.ravel()), s.shape[1])
    if same:
        i, j = i[i < j], j[i < j]
    way = np.maximum(np.maximum(x.away[i], y.away[j]), order.longest(x.place[i], y.place[j]))
    near = s[i, j] >= cosine(way)
    i, j, way = i[near], j[near], way[near]
    if len(i) > DENSE * (len(s) + s.shape[1]):
        v, core, ids = (x.v, x.core, x.ids) if same else (np.concatenate(c) for c in ((x.v, y.v), (x.core, y.core), (x.ids, y.ids)))
        a, b = _tree(v, core)
        return _edge_table(ids[a], ids[b], _lengths(v[a], v[b], core[a], core[b]))
    w = _lengths(x.v[i], y.v[j], x.core[i], y.core[j])
    i, j, w = i[w < way], j[w < way], w[w < way]
    return _edge_table(x.ids[i], y.ids[j], w)


def _slack(dims: int) -> float:
    """What cosines in single precision can be off by, rounded up."""
    return (dims + 8) * 2.0 ** -23


def spanning_tree(blocks: Blocks, rows: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b, w) of the minimum spanning tree of rows(id, v, core, cell, page, tile) under mutual reachability."""
    if blocks.total <= few:
        return _tree_of_pages(blocks, rows)
    spark, dims = blocks.spark, blocks.dims
    marks = cut(rows.select("id", "v", "core").orderBy(F.xxhash64("id"), "id").limit(max(2, min(LANDMARKS, SAMPLE_CELLS // dims, blocks.total // 16))))
    t = marks.toArrow()
    ids, v, core = t["id"].to_numpy(), matrix(t["v"], dims), t["core"].to_numpy()
    if len(ids) <= few:
        a, b = _tree(v, core)
    else:
        inner = Blocks(marks, "id", "v", keep=("core",), page=blocks.page, tile=blocks.tile)
        e = spanning_tree(inner, inner.rows, few).toArrow()  # an edge a landmark
        by = np.argsort(ids)
        a, b = (by[np.searchsorted(ids, e[c].to_numpy(), sorter=by)] for c in ("a", "b"))
    w = _lengths(v[a], v[b], core[a], core[b])
    order = Order(len(ids), a, b, w)
    drop(marks)
    known = spark.sparkContext.broadcast((ids, v, v.astype(np.float32), core, order.place))
    names = rows.columns

    def attach(batches):
        ids, v, single, core, place = known.value
        least = core.any()
        for batch in batches:
            x, own = matrix(batch.column(names.index("v")), dims), batch.column(names.index("core")).to_numpy()
            at = np.zeros(len(x), np.int64)
            for k in range(0, len(x), 256):
                s = x[k:k + 256].astype(np.float32) @ single.T
                at[k:k + 256] = np.maximum(np.maximum(2 - 2 * s, 0), core.astype(np.float32) ** 2).argmin(1) if least else s.argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(place[at]), pa.array(_lengths(x, v[at], own, core[at])), pa.array(ids[at])], [*names, "place", "away", "mark"])

    types = dict(rows.dtypes)
    placed = cut(rows.mapInArrow(attach, ", ".join(f"`{c}` {types[c]}" for c in names) + ", place long, away double, mark long"))
    low, high, away = np.zeros(len(blocks.count), np.int64), np.zeros(len(blocks.count), np.int64), np.zeros(len(blocks.count))
    for r in placed.groupBy("cell").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.max("away").alias("away")).collect():  # a row a cell
        low[r.cell], high[r.cell], away[r.cell] = r.low, r.high, r.away
    ways = np.maximum(np.maximum(away[:, None], away[None, :]), order.longest(np.minimum(low[:, None], low[None, :]), np.maximum(high[:, None], high[None, :])))
    ordered, slack, ddl = spark.sparkContext.broadcast(order), _slack(dims), "a long, b long, w double"
    found = cut(blocks.meet(blocks.pairs(_angle(ways)), lambda x, y, same: _shorter(x, y, same, ordered.value, slack), ddl, placed, graph.thinned, lambda t: Page(t, dims, ordered.value)))
    tree = spark.createDataFrame(_edge_table(ids[a], ids[b], w), ddl)
    return graph.spanning_forest(found.union(placed.select("id", "mark", "away")).union(tree))


def _tree_of_pages(blocks: Blocks, rows: DataFrame) -> DataFrame:
    dims = blocks.dims

    def task(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        t = x if same else pa.concat_tables([x, y])
        v, core, ids = matrix(t["v"], dims), t["core"].to_numpy(), t["id"].to_numpy()
        a, b = _tree(v, core)
        return _edge_table(ids[a], ids[b], _lengths(v[a], v[b], core[a], core[b]))

    ddl = "a long, b long, w double"
    own = cut(blocks.meet([(i, i) for i, n in enumerate(blocks.count) if n], task, ddl, rows, graph.thinned))
    if len(blocks.count) == 1:
        return own if blocks.pages[0] == 1 else graph.spanning_forest(own)
    # One row of each cell, a tree over these, and the trees of the cells span all rows: no edge longer than their longest is needed.
    reps = rows.groupBy("cell").agg(F.min_by(F.struct("v", "core"), "id").alias("r")).collect()  # a row a cell
    v, core = np.array([r.r.v for r in reps]), np.array([r.r.core for r in reps])
    a, b = _tree(v, core)
    most = np.maximum(np.sqrt(((v[a] - v[b]) ** 2).sum(1)), np.maximum(core[a], core[b])).max(initial=0)
    most = max(float(most), own.agg(F.max("w")).first()[0] or 0.0)
    later = [p for p in blocks.pairs(float(_angle(most))) if p[0] != p[1]]
    return graph.spanning_forest(own.union(cut(blocks.meet(later, task, ddl, rows, graph.thinned))) if later else own)


STATE = "node long, size long, stay double, below double, cluster string, points array<long>"
CLOSED = "cluster string, parent string, kept boolean"


class Part:
    """A component's state while its edges are taken from short to long. size: rows; cluster: the one open in it, if it holds `least`
    rows, with `stay`, the sum of its points' densities of leaving, and `below`, the best stability of what it split into; else its
    points."""

    __slots__ = ("size", "stay", "below", "cluster", "points")

    def __init__(self, size, stay, below, cluster, points):
        self.size, self.stay, self.below, self.cluster, self.points = size, stay, below, cluster, points


def merged(parts: list[Part], w: float, name: int, closed: list, joined: list) -> Part:
    """What components become that meet at length w; name: their least id."""
    density = 1 / w
    size = sum(p.size for p in parts)
    large = [p for p in parts if p.cluster is not None]
    small = [x for p in parts if p.cluster is None for x in p.points]
    if len(large) == 1:  # the rest falls out of it, seen from above
        one = large[0]
        joined += [(x, one.cluster) for x in small]
        return Part(size, one.stay + (size - one.size) * density, one.below, one.cluster, None)
    return Part(size, 0.0, 0.0, None, small) if not large else _split(large, small, size, density, f"{name}:{w!r}", closed, joined)


def _split(large: list[Part], small: list, size: int, density: float, name: str, closed: list, joined: list) -> Part:
    below = 0.0
    for p in large:
        own = p.stay - p.size * density
        kept = own >= p.below
        closed.append((p.cluster, name, bool(kept)))
        below += own if kept else p.below
    joined += [(x, name) for x in small]
    return Part(size, size * density, below, name, None)


def opened(part: Part, w: float, name: int, least: int, joined: list) -> Part:
    """A component that has just grown to `least` rows opens a cluster."""
    if part.cluster is None and part.size >= least:
        cluster = f"{name}:{w!r}"
        joined += [(x, cluster) for x in part.points]
        return Part(part.size, part.size / w, 0.0, cluster, None)
    return part


def contract(edges: list[tuple[float, int, int]], parts: dict[int, Part], least: int, closed: list, joined: list) -> dict[int, Part]:
    """The components of `parts` left after all edges, lengths in rising order and each length at once."""
    sets = graph.Union()
    edges = sorted(edges)
    at = 0
    while at < len(edges):
        end = at
        while end < len(edges) and edges[end][0] == edges[at][0]:
            end += 1
        w, before = edges[at][0], {}
        for _, a, b in edges[at:end]:
            for x in (a, b):
                root = sets.find(x)
                if root in parts:
                    before[root] = parts.pop(root)
            sets.join(a, b)
        groups: dict[int, list[Part]] = {}
        for root in sorted(before):
            groups.setdefault(sets.find(root), []).append(before[root])
        for root, group in groups.items():
            parts[root] = opened(merged(group, w, root, closed, joined), w, root, least, joined)
        at = end
    return parts


def _contract_group(least: int):
    """applyInArrow body: nodes and edges of whole components -> their states, the clusters closed and the points that joined one."""
    schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("size", pa.int64()), ("stay", pa.float64()), ("below", pa.float64()), ("cluster", pa.string()), ("points", pa.list_(pa.int64())), ("parent", pa.string()), ("kept", pa.bool_())])

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        parts = {r["node"]: Part(r["size"], r["stay"], r["below"], r["cluster"], r["points"]) for r in nodes.to_pylist()}
        closed, joined = [], []
        left = contract(list(zip(*(edges[c].to_pylist() for c in ("w", "a", "b")), strict=True)), parts, least, closed, joined)
        out = [dict(kind=0, node=n, size=p.size, stay=p.stay, below=p.below, cluster=p.cluster, points=p.points) for n, p in left.items()]
        out += [dict(kind=1, cluster=c, parent=q, kept=k) for c, q, k in closed] + [dict(kind=2, node=x, cluster=c) for x, c in joined]
        return pa.Table.from_pylist(out, schema)

    return run


_OUT = "kind int, node long, size long, stay double, below double, cluster string, points array<long>, parent string, kept boolean"


def condense(points: DataFrame, edges: DataFrame, least: int, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """points(id, copies), tree edges(a, b, w) -> clusters (cluster, parent, kept), members (id, cluster)."""
    alone = F.col("copies") >= least  # copies of one vector are a cluster from the start
    name = F.concat(F.col("id").cast("string"), F.lit(":0"))
    state = cut(points.select(F.col("id").alias("node"), F.col("copies").alias("size"), F.when(alone, F.col("copies") / NEAR).otherwise(0.0).alias("stay"), F.lit(0.0).alias("below"), F.when(alone, name).alias("cluster"), F.when(~alone, F.array("id")).alias("points")))
    members = points.where(alone).select("id", name.alias("cluster"))
    clusters = None
    edges = cut(edges)
    while (left := edges.count()):
        share = min(1.0, part / left)
        while True:
            level = edges if share == 1.0 else edges.where(F.col("w") <= edges.agg(F.percentile_approx("w", share, 10_000)).first()[0])
            of = cut(graph.connected_components(level.select("a", "b"), alone=graph.HELD // 2))
            most = level.join(of, F.col("a") == F.col("id")).groupBy("component").count().agg(F.max("count")).first()[0]
            if most <= part or share <= 1e-4:
                break
            share /= 4
        if most > part:  # as few lengths as there can be; a component of more edges than `part` is still one task
            shortest = edges.agg(F.min("w")).first()[0]
            level = edges.where(F.col("w") == shortest)
            of = cut(graph.connected_components(level.select("a", "b"), alone=graph.HELD // 2))
        known = of.toDF("node", "component")
        nodes = state.join(known, "node")
        deal = F.pmod(F.xxhash64("component"), F.lit(-(-4 * level.count() // part))).alias("deal")  # whole components, many to a task
        lines = level.join(of.toDF("a", "component"), "a").select("component", "w", "a", "b")
        if most > part:
            out = cut(_join_at_once(nodes, shortest, least))
        else:
            out = cut(nodes.groupBy(deal).cogroup(lines.groupBy(deal)).applyInArrow(_contract_group(least), _OUT))
        now = out.where("kind = 1").select("cluster", "parent", "kept")
        clusters = now if clusters is None else clusters.union(now)
        members = members.union(out.where("kind = 2").select(F.col("node").alias("id"), "cluster"))
        state = cut(state.join(known, "node", "left_anti").union(out.where("kind = 0").select("node", "size", "stay", "below", "cluster", "points")))
        rest = edges.join(level.select("a", "b"), ["a", "b"], "left_anti")
        a, b = of.toDF("a", "ca"), of.toDF("b", "cb")
        edges = cut(rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "w"))
    top = state.where("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("kept"))
    return top if clusters is None else clusters.union(top), members


def _join_at_once(nodes: DataFrame, w: float, least: int) -> DataFrame:
    """The rule of `merged` as grouped sums: components of any size that edges of one length join."""
    big = F.col("cluster").isNotNull()
    own = F.col("stay") - F.col("size") / w
    kept = own >= F.col("below")
    g = nodes.groupBy("component").agg(
        F.sum("size").alias("size"), F.count_if(big).alias("large"), F.sum(F.when(big, F.when(kept, own).otherwise(F.col("below")))).alias("best"),
        F.max(F.when(big, F.struct("cluster", "stay", "below", "size"))).alias("one"))
    name = F.concat(F.col("component").cast("string"), F.lit(f":{w!r}"))
    single, split, fresh = F.col("large") == 1, F.col("large") > 1, (F.col("large") == 0) & (F.col("size") >= least)
    g = g.withColumns({"name": F.when(single, F.col("one.cluster")).when(split | fresh, name), "split": split, "single": single})
    few = nodes.where(F.size("points") > 0).join(g.where("name is null").select("component"), "component").groupBy("component").agg(F.flatten(F.collect_list("points")).alias("points"))  # under `least` points
    null = lambda t: F.lit(None).cast(t)
    state = g.join(few, "component", "left").select(
        F.lit(0).alias("kind"), F.col("component").alias("node"), "size",
        F.when(single, F.col("one.stay") + (F.col("size") - F.col("one.size")) / w).when(F.col("name").isNotNull(), F.col("size") / w).otherwise(0.0).alias("stay"),
        F.when(single, F.col("one.below")).when(split, F.col("best")).otherwise(0.0).alias("below"), F.col("name").alias("cluster"), F.when(F.col("name").isNull(), F.col("points")).alias("points"), null("string").alias("parent"), null("boolean").alias("kept"))
    with_name = nodes.join(g.select("component", "name", "split"), "component")
    closed = with_name.where(big & F.col("split")).select(F.lit(1), null("long"), null("long"), null("double"), null("double"), "cluster", null("array<long>"), "name", kept)
    joined = with_name.where(~big & F.col("name").isNotNull()).select(F.explode("points").alias("p"), "name").select(F.lit(2), "p", null("long"), null("double"), null("double"), "name", null("array<long>"), null("string"), null("boolean"))
    return state.union(closed).union(joined)


def selected(clusters: DataFrame, most: int = 64) -> DataFrame:
    """(cluster, top): the outermost kept cluster that holds each one, null without. Paths to the root double in every round."""
    t = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("cluster")).alias("top")))
    for _ in range(most):
        if t.where("up is not null").isEmpty():
            return t.select("cluster", "top")
        above = t.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("outer"))
        t = cut(t.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("outer", "top").alias("top")))
    raise RuntimeError("clusters nest too deep")


def clusters(rows: DataFrame, key: str, vector: str, min_cluster_size: int = 2, min_samples: int = 1, page: int = 1024, cells: int | None = None, part: int = PART, few: int = FEW) -> DataFrame:
    """(id, component): the smallest key of the density cluster that a row is in; noise, and rows whose vector takes no part (null, empty,
    zero, or with a null or non-finite component), are their own component. Labels don't depend on the partitioning."""
    part_taking = usable(vector) & F.exists(vector, lambda c: c != 0)
    ids = cut(rows.select(F.col(key).alias("id"), F.when(part_taking, F.transform(vector, lambda c: c.cast("double"))).alias("v")))
    folded = cut(ids.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("first")).withColumn("uid", F.monotonically_increasing_id()))
    blocks = Blocks(folded, "uid", "v", keep=("copies",), cells=cells, page=page, tile=2 * TILE)
    if blocks.total < 1:
        return ids.select("id", F.col("id").alias("component"))
    core = F.lit(0.0).alias("core")
    pages = blocks.rows.withColumn("core", core)
    if min_samples > 1:
        pages = cut(blocks.rows.join(core_distances(blocks, min_samples).withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select(*blocks.rows.columns, F.coalesce("core", F.lit(2.0)).alias("core")))
    tree = spanning_tree(blocks, pages, few)
    found, members = condense(folded.select(F.col("uid").alias("id"), "copies"), tree, max(2, min_cluster_size), part)
    label = members.join(selected(found), "cluster").where("top is not null").select(F.col("id").alias("uid"), "top")
    named = ids.where("v is not null").join(folded.select("v", "uid"), "v").join(label, "uid", "left").select("id", "top")
    least = named.where("top is not null").groupBy("top").agg(F.min("id").alias("component"))
    out = named.join(least, "top", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out.union(ids.where("v is null").select("id", F.col("id").alias("component")))
