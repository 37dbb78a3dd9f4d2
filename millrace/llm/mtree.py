"""Exact top-k by inner product with paged M-trees searched best first.

Vectors are turned into integers floor(scale * x). Rows are dealt into pages by a hash of their id; each page becomes a two-level
M-tree: routing vectors (chosen by farthest-first from the page) with covering radii, each leaf entry with its stored distance to
its routing vector. With |x|^2 known, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a lower bound on the distance and the node's largest
norm give an upper bound on every score below the node: max(q.x) <= (|q|^2 + max|x|^2 - max(0, d(q, c) - r)^2) / 2, and also
<= q.c + |q| r. A query block visits a page's nodes in falling order of bound and stops once no bound can reach the k-th score it
already holds; within a node, entries whose stored parent distance rules them out by the triangle inequality are not computed.

Queries meet the pages in blocks (a stated query set against all rows). Every query first searches the page of its own row, and
that k-th score goes with it to the other pages, which return only scores that reach it.

Defined results: vectors null, empty, or holding a null or non-finite component take no part, neither as query nor as candidate;
vectors of different lengths are compared as if the shorter had zeros at its end; equal scores rank by smaller id; rows that
repeat an id are each a candidate for other ids' queries, and a query never meets its own id. Scores must fit 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

_EXACT = float(1 << 52)
_LOW = -(1 << 63) + 1  # its negative still fits


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims), np.float64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, np.float64)
        out[i, : len(v)] = v
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through doubles where they cannot lose a bit."""
    big = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return (q @ x.T).astype(np.int64) if big < _EXACT else q.astype(np.int64) @ x.astype(np.int64).T


class Page:
    """A paged M-tree over one page's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 128):
        n = len(x)
        m = max(1, -(-n // leaf))
        self.norm2 = (x * x).sum(1)
        picks, far = [0], np.full(n, np.inf)
        label = np.zeros(n, np.int64)
        near = np.full(n, np.inf)
        for j in range(m):  # farthest-first routing vectors; each entry goes to its nearest one
            if j:
                picks.append(int(far.argmax()))
            d = np.sqrt(np.maximum(self.norm2 + self.norm2[picks[-1]] - 2 * (x @ x[picks[-1]]), 0))
            closer = d < near
            label[closer], near[closer] = j, d[closer]
            far = np.minimum(far, d)
        order = np.lexsort((near, label))
        self.ids, self.x, self.norm2, self.parent = ids[order], x[order], self.norm2[order], near[order]
        self.at = np.searchsorted(label[order], np.arange(m + 1))
        full = np.flatnonzero(self.at[1:] > self.at[:-1])
        self.centre = x[picks][full]
        self.at = np.stack([self.at[full], self.at[full + 1]], 1)
        self.radius = np.array([self.parent[a:b].max() for a, b in self.at])
        self.top2 = np.array([self.norm2[a:b].max() for a, b in self.at])

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its up to k best (score, -id) of this page, own id left out, none under its floor."""
        q2 = (q * q).sum(1)
        slack = 1e-6 * (1 + q2[:, None] + self.top2[None, :])  # doubles only prune; they must never prune too much
        dist = np.sqrt(np.maximum(q2[:, None] + (self.centre * self.centre).sum(1)[None, :] - 2 * q @ self.centre.T, 0))
        gap = np.maximum(dist - self.radius[None, :], 0)
        bound = np.minimum((q2[:, None] + self.top2[None, :] - gap * gap) / 2, q @ self.centre.T + np.sqrt(q2)[:, None] * self.radius[None, :]) + slack
        best = np.full((len(q), k), _LOW, np.int64)
        name = np.full((len(q), k), np.iinfo(np.int64).max)
        reach = floor.astype(np.float64)
        queue = [(-b, j) for j, b in enumerate(bound.max(0))]
        heapq.heapify(queue)
        while queue:
            _, j = heapq.heappop(queue)
            live = np.flatnonzero(bound[:, j] >= reach)
            if not len(live):
                continue
            a, b = self.at[j]
            # Stored parent distances: |d(q, c) - d(x, c)| <= d(q, x), so entries out of reach for every live query are skipped.
            need = np.sqrt(np.maximum(q2[live] + self.top2[j] - 2 * (reach[live] - slack[live, j]), 0))
            lo, hi = (dist[live, j] - need).min() - 1e-6, (dist[live, j] + need).max() + 1e-6
            a, b = a + np.searchsorted(self.parent[a:b], lo, "left"), a + np.searchsorted(self.parent[a:b], hi, "right")
            if a >= b:
                continue
            s = _scores(q[live], self.x[a:b])
            i = self.ids[a:b]
            s = np.where(i[None, :] == qid[live][:, None], _LOW, s)
            s = np.concatenate([best[live], s], 1)
            i = np.concatenate([name[live], np.broadcast_to(i, (len(live), b - a))], 1)
            if s.shape[1] > 4 * k:
                cutoff = -np.partition(-s, k - 1, 1)[:, k - 1]
                width = int((s >= cutoff[:, None]).sum(1).max())  # ties at the k-th score stay in
                keep = np.argpartition(-s, min(width, s.shape[1]) - 1, 1)[:, :width]
                s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            best[live], name[live] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            reach[live] = np.maximum(reach[live], best[live, k - 1].astype(np.float64))
        return [[(int(s), -int(i)) for s, i in zip(best[r], name[r], strict=True) if s > _LOW and s >= floor[r]] for r in range(len(q))]


def _search_pages(k: int, own: bool, block: int):
    """mapInArrow body over pages: a row holds a page's vectors and the queries that visit it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not row["ids"] or not row["qids"]:
                    continue
                dims = max(len(v) for v in (*row["vecs"], *row["qvecs"])) // 8
                page = Page(np.array(row["ids"], np.int64), _matrix(row["vecs"], dims))
                qid, floor = np.array(row["qids"], np.int64), np.array(row["floors"], np.int64)
                for at in range(0, len(qid), block):
                    part = slice(at, at + block)
                    found = page.search(qid[part], _matrix(row["qvecs"][part], dims), floor[part], k)
                    out = [(int(q), -i, s) for q, f in zip(qid[part], found, strict=True) for s, i in f]
                    if out:
                        q, v, s = zip(*out, strict=True)
                        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (binary of doubles) for the vectors that take part."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    pack = F.udf(lambda v: np.array(v, np.float64).tobytes(), "binary", useArrow=True)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), pack(F.transform(e, lambda x: F.floor(x * scale).cast("double"))).alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, page_rows: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of all other ids for every id divisible by `every`."""
    spark = vectors.sparkSession
    data = cut(quantise(vectors, scale))
    total = data.count()
    n_pages = max(1, -(-total // page_rows))
    page = lambda c: F.pmod(F.xxhash64(c), F.lit(n_pages))
    low = F.lit(_LOW).cast("long")
    rows = data.select(page("vec_id").alias("page"), "vec_id", "v")
    pages = rows.groupBy("page").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vecs"))  # a page holds about page_rows rows
    asked = data.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))

    def visit(q: DataFrame, own: bool) -> DataFrame:
        blocks = q.groupBy("page", F.pmod(F.xxhash64("qid", F.lit(7)), F.col("blocks")).alias("b")).agg(F.collect_list("qid").alias("qids"), F.collect_list("qv").alias("qvecs"), F.collect_list("floor").alias("floors"))
        met = pages.join(blocks, "page").select("ids", "vecs", "qids", "qvecs", "floors")
        return met.mapInArrow(_search_pages(k, own, block), _FOUND)

    n_q = asked.count()
    home = asked.select(page("qid").alias("page"), "qid", "qv", low.alias("floor"), F.lit(1).alias("blocks"))
    first = cut(visit(home, True))
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select(F.col("query_id").alias("qid"), F.col("s").alias("floor"))
    others = asked.join(floors, "qid", "left").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))).alias("page"), "qid", "qv", F.coalesce("floor", low).alias("floor"), F.lit(max(1, -(-n_q // (4 * block)))).alias("blocks"))
    rest = visit(others.where(F.col("page") != page("qid")), False) if n_pages > 1 else spark.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
