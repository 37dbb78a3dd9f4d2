"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (SAMPLE rows and SAMPLE_CELLS entries at most, chosen by a hash of id and vector): a node of more
than its share of rows is split by k-means into up to `branch` children, until a leaf stands for about `leaf_rows` rows or there are
MAX_LEAVES leaves. Every row is indexed: it goes down the tree to its leaf. A node's priority for a query is q.c + |q| * r, c its
centre and r the root mean square distance of its sample; a priority queue pops nodes, opens inner ones, and so puts the leaves in the
order in which the query visits them.

How many leaves a query visits is calibrated: for at most `probes` queries the exact neighbours among all rows are computed, each
neighbour's leaf is looked up in the visiting order, and the visits are widened until the share of neighbours met reaches `recall`
(all leaves where nothing less does). A query that has met fewer than k other rows goes on visiting. The first leaves of each query
give its k-th score so far, and the later ones return only what reaches it.

Rows meet queries by shelf, page and block. A shelf is some leaves beside each other, of `shelf_rows` rows or so; a query goes to it once,
with the leaves that it visits there, not once for every leaf. A shelf of more rows is split into pages, its visitors into blocks of as
many, so no task holds a hot leaf. Of equal vectors only the k + 1 smallest ids can be among any query's k best; the others are folded away
before the index, by a window that Spark limits ahead of its shuffle.

Defined results: vectors null, empty, zero, or with a null or non-finite component, and rows with a null id, take no part; vectors of
other lengths count as if the shorter had zeros at its end; rows that repeat both id and vector count once; of rows that repeat an id
with other vectors each is a candidate and, where asked, a query, its own row alone left out; equal scores rank by smaller id. Scores are
sums of products of doubles, added the same way for every row, so equal vectors score equally. Empty tables give no rows. Columns
other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

SAMPLE, SAMPLE_CELLS = 1 << 17, 1 << 24  # rows, and entries, of the sample that the tree is fitted on
MAX_LEAVES = 1 << 14
SHELVES, SHELF_CELLS = 64, 1 << 20  # shelves wanted, and entries of a page or a block
ASKED = 256  # queries whose visits are listed at once


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists as a matrix, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _split(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means from rows spread evenly over the sample; the label of each row."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for turn in range(rounds + 1):
        label = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        if turn < rounds:
            n = np.bincount(label, minlength=k)
            s = np.zeros_like(c)
            np.add.at(s, label, x)
            c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return label


class Tree:
    """Nodes in arrays: centre, radius, the children's range, and the number of each leaf."""

    def __init__(self, sample: np.ndarray, weight: float, leaf_rows: int, branch: int, max_leaves: int):
        """weight: rows of the table that a row of the sample stands for."""
        most = max(leaf_rows, len(sample) * weight / max(1, max_leaves // 2))  # splits stop there, so leaves stay under max_leaves
        parts = [np.arange(len(sample))]
        centre, radius, child = [], [], []
        at = 0
        while at < len(parts):
            x = sample[parts[at]]
            centre.append(x.mean(0) if len(x) else np.zeros(sample.shape[1]))
            radius.append(float(np.sqrt(((x - centre[-1]) ** 2).sum(1).mean())) if len(x) else 0.0)
            want = min(branch, int(np.ceil(len(x) * weight / most)), len(x), max_leaves - len(parts))
            labels = _split(x, want) if want > 1 and radius[-1] > 0 else np.zeros(len(x), np.int64)
            found = np.unique(labels)
            child.append((len(parts), len(parts) + len(found)) if len(found) > 1 else (0, 0))
            if len(found) > 1:
                parts += [parts[at][labels == j] for j in found]
            at += 1
        self.centre, self.radius, self.child = np.array(centre), np.array(radius), child
        self.norm2 = (self.centre**2).sum(1)
        self.leaf = np.full(len(child), -1)
        ends = [i for i, (a, b) in enumerate(child) if a == b]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        at = np.zeros(len(x), np.int64)
        queue = [(0, np.arange(len(x)))]
        while queue:
            node, rows = queue.pop()
            a, b = self.child[node]
            if a == b:
                at[rows] = self.leaf[node]
                continue
            near = (self.norm2[a:b] - 2 * (x[rows] @ self.centre[a:b].T)).argmin(1)
            queue += [(a + int(j), rows[near == j]) for j in np.unique(near)]
        return at

    def orders(self, q: np.ndarray, visits: int, held: np.ndarray, least: int):
        """For each query the leaves in visiting order: `visits` of them, and more until they hold `least` rows."""
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            rank = -(part @ self.centre.T + np.sqrt((part * part).sum(1))[:, None] * self.radius[None, :])
            for p in rank:
                queue, out, rows = [(p[0], 0)], [], 0
                while queue and (len(out) < visits or rows < least):
                    _, node = heapq.heappop(queue)
                    a, b = self.child[node]
                    if a == b:
                        out.append(int(self.leaf[node]))
                        rows += int(held[out[-1]])
                    for j in range(a, b):
                        heapq.heappush(queue, (p[j], j))
                yield out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q.x row by row, every row added up in the same order."""
    return (q * x).sum(1)


def _best(qs: np.ndarray, qid: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query, row, score) triples that hold every query's k best of these rows at or over its floor, its own row left out."""
    fast = qs @ x.T
    slack = 1e-12 * (1 + np.sqrt((qs * qs).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0))) * max(1, x.shape[1])
    reach = floor - slack
    if len(x) > k + 1:
        reach = np.maximum(reach, np.partition(fast, len(x) - k - 1, 1)[:, len(x) - k - 1] - 2 * slack)  # k + 1: one may be its own
    q, r = np.nonzero(fast >= reach[:, None])
    own = qid[q] == ids[r]
    own[own] = (qs[q[own]] == x[r[own]]).all(1)
    q, r = q[~own], r[~own]
    s = _products(qs[q], x[r])
    keep = s >= floor[q]
    q, r, s = q[keep], r[keep], s[keep]
    order = np.lexsort((ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k], s[place < k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part, each different one once."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).distinct()


def _leaves(tree, dims: int):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(tree.value.assign(_matrix(b.column(1), dims)), pa.int32())], ["vec_id", "v", "leaf"])

    return run


def _visits(tree, dims: int, visits: int, near: int, held: np.ndarray, shelf: np.ndarray, least: int):
    """A row for each query and shelf that it goes to: the leaves among its first `near` that are there, and the later ones."""

    def run(batches):
        for b in (b.slice(lo, ASKED) for b in batches for lo in range(0, b.num_rows, ASKED)):
            orders = [np.array(o) for o in tree.value.orders(_matrix(b.column(2), dims), visits, held, least)]
            of = np.repeat(np.arange(len(orders)), [len(o) for o in orders])
            leaf = np.concatenate(orders)
            late = np.concatenate([np.arange(len(o)) >= near for o in orders])
            order = np.lexsort((shelf[leaf], of))
            of, leaf, late = of[order], leaf[order], late[order]
            new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (shelf[leaf][1:] != shelf[leaf][:-1])))
            part = lambda on: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(on, new, dtype=np.int64))), pa.int32()), pa.array(leaf[on], pa.int32()))  # noqa: E731,B023
            yield pa.record_batch([*(c.take(pa.array(of[new])) for c in b.columns), pa.array(shelf[leaf[new]], pa.int32()), part(~late), part(late)], [*b.schema.names, "shelf", "near", "far"])

    return run


def _meet(k: int, dims: int):
    """applyInArrow body: a page's rows and a block of its visitors -> the k best that each visitor meets."""

    def run(rows: pa.Table, visitors: pa.Table) -> pa.Table:
        if not rows.num_rows or not visitors.num_rows:
            return _FOUND_SCHEMA.empty_table()
        leaf = rows["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        ids, x, leaf = rows["vec_id"].to_numpy()[order], _matrix(rows["v"], dims)[order], leaf[order]
        out = []
        for b in visitors.to_batches(max_chunksize=1024):
            qv, qid, floor, goes = _matrix(b.column("qv"), dims), b.column("qid").to_numpy(), b.column("floor").to_numpy(), b.column("leaves")
            who = np.repeat(np.arange(len(qid)), goes.value_lengths().to_numpy())
            where = goes.flatten().to_numpy()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for one in np.unique(where):
                lo, hi = np.searchsorted(leaf, [one, one + 1])
                w = who[where == one]
                if lo < hi:
                    q, r, s = _best(qv[w], qid[w], floor[w], ids[lo:hi], x[lo:hi], k)
                    found.append((w[q], r + lo, s))
            q, r, s = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pa.table([pa.array(b.column("qno").to_numpy()[q[first]]), pa.array(ids[r[first]]), pa.array(s[first])], schema=_FOUND_SCHEMA))
        return pa.concat_tables(out)

    return run


def shelves(held: np.ndarray, rows: int) -> np.ndarray:
    """The shelf of each leaf: leaves beside each other of about `rows` rows, numbered from 0."""
    at = np.cumsum(held) - held
    return np.unique(at // max(1, rows), return_inverse=True)[1]


_FOUND = "qno long, vec_id long, score double"
_FOUND_SCHEMA = pa.schema([("qno", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _probe(tree, qno: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, dims: int):
    """mapInArrow body: this task's k best rows of each probe, and their leaves."""

    def run(batches):
        found = np.zeros((0, 4))
        for b in batches:
            x = _matrix(b.column(1), dims)
            i, r, s = _best(q, qid, np.full(len(q), -np.inf), b.column(0).to_numpy(), x, k)
            found = np.concatenate([found, np.stack([i, s, b.column(2).to_numpy()[r], np.zeros(len(i))], 1)])
            found = found[np.lexsort((-found[:, 1], found[:, 0]))]
            found = found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0]) < k]
        if len(found):
            yield pa.record_batch([pa.array(qno[found[:, 0].astype(int)]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32))], ["qno", "score", "leaf"])

    return run


def _first(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def calibrate(data: DataFrame, asked: DataFrame, tree, dims: int, held: np.ndarray, k: int, recall: float, probes: int) -> int:
    """The fewest leaves to visit at which the probes meet the share `recall` of their exact neighbours."""
    few = asked.orderBy(F.xxhash64("qno"), "qno").limit(probes).collect()
    q = np.zeros((len(few), dims))
    for i, r in enumerate(few):
        q[i, : len(r.qv)] = r.qv
    qno = np.array([r.qno for r in few], np.int64)
    exact = data.mapInArrow(_probe(tree, qno, np.array([r.qid for r in few], np.int64), q, k, dims), "qno long, score double, leaf int")
    near = _first(exact, "qno", [F.desc("score"), "leaf"], k).select("qno", "leaf").collect()  # at most k rows a probe
    leaves = tree.value.leaves
    wanted: dict[int, list[int]] = {}
    for r in near:
        wanted.setdefault(r.qno, []).append(r.leaf)
    met = []
    for n, o in zip(qno.tolist(), tree.value.orders(q, leaves, held, 0), strict=True):
        place = np.argsort(o)
        met += place[wanted.get(n, [])].tolist()
    met = np.sort(met)
    return leaves if not len(met) else int(met[min(len(met), int(np.ceil(recall * len(met)))) - 1]) + 1


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, leaf_rows: int = 512, branch: int = 16, probes: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all other rows for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    whole = usable(vectors)
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = cut(whole.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v"))
    total, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(1, min(SAMPLE, SAMPLE_CELLS // dims))
    share = min(1.0, most / total)
    sample = rows.where((F.xxhash64("vec_id", "v").cast("double") / float(1 << 64) + 0.5) < share * 1.0).select("v").limit(most) if share < 1 else rows.select("v").limit(most)
    x = _matrix(sample.toArrow().column("v"), dims)
    tree = spark.sparkContext.broadcast(Tree(x, total / max(1, len(x)), leaf_rows, branch, max(1, min(MAX_LEAVES, SAMPLE_CELLS // dims))))
    data = cut(rows.mapInArrow(_leaves(tree, dims), "vec_id long, v array<double>, leaf int"), rows)
    held = np.zeros(tree.value.leaves, np.int64)
    for r in data.groupBy("leaf").count().collect():  # at most MAX_LEAVES rows
        held[r.leaf] = r["count"]
    asked = cut(whole.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("qno"), F.col("vec_id").alias("qid"), F.col("v").alias("qv")))
    visits = calibrate(data, asked, tree, dims, held, k, recall, probes)
    wide = max(1, min(SHELF_CELLS // dims, max(2048, total // SHELVES)))  # rows of a page, visitors of a block
    shelf = shelves(held, wide)
    size = np.bincount(shelf, held).astype(np.int64)
    listed = _visits(tree, dims, visits, max(1, visits // 8), held, shelf, k + 1)
    plan = cut(asked.mapInArrow(listed, "qno long, qid long, qv array<double>, shelf int, near array<int>, far array<int>"))
    of = F.broadcast(spark.createDataFrame(list(enumerate(shelf.tolist())), "leaf int, shelf int"))  # at most MAX_LEAVES rows
    placed = data.join(of, "leaf")

    def met(visitors: DataFrame) -> DataFrame:
        """What visitors(qno, qid, qv, floor, shelf, leaves) find; every page of a shelf meets every block of its visitors."""
        shape = [(r.shelf, -(-int(size[r.shelf]) // wide), -(-r["count"] // wide)) for r in visitors.groupBy("shelf").count().collect() if size[r.shelf]]  # a row a shelf
        shape = F.broadcast(spark.createDataFrame(shape, "shelf int, pages int, blocks int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = placed.join(shape, "shelf").select("vec_id", "v", "leaf", "shelf", deal("vec_id", "pages").alias("page"), spread("blocks").alias("block"))
        right = visitors.join(shape, "shelf").select("qno", "qid", "qv", "floor", "leaves", "shelf", spread("pages").alias("page"), deal("qno", "blocks").alias("block"))
        key = ("shelf", "page", "block")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(k, dims), _FOUND)

    order = [F.desc("score"), "vec_id"]
    visitors = lambda leaves: plan.where(F.size(leaves) > 0).select("qno", "qid", "qv", "shelf", F.col(leaves).alias("leaves"))
    first = cut(_first(met(visitors("near").withColumn("floor", F.lit(float("-inf")))), "qno", order, k))
    floors = first.where(F.col("rank") == k).select("qno", F.col("score").alias("floor"))
    later = visitors("far").join(floors, "qno", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = _first(first.drop("rank").union(met(later)), "qno", order, k)
    return best.join(asked.select("qno", F.col("qid").alias("query_id")), "qno").select("query_id", "rank", "vec_id", "score")
