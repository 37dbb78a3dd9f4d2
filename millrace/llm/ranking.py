"""Ranked lexical search: a hierarchical max tree over document ranges per term, searched best first by branch and bound.

Scores are sums over an item's terms of integer impacts that depend on the term and the document alone:
w * ((10**9 * tf) div (1000 * tf + 12 * m)), w the term's weight and m the document's length norm. No impact is negative. Documents
are dealt into ranges of LEAF; for every term of the items a node holds the highest impact in its range, and FAN nodes form the next
node up. The sum of an item's node values bounds every score below the node. A search pops the node of the highest bound, opens it or,
at a leaf, scores its documents exactly; it ends once the highest bound left lies under the k-th score held. Nodes whose bound equals
that score are opened: a document of a smaller id may stand in them.

One pass over the texts keeps of each document its term count and the items' terms in it (`index`). The counts N, L and df come from
there, over all documents. Every task then builds the trees of its own documents and searches them for each item; what it returns for
an item is at most k rows. A first search over a sixteenth of the documents gives each item a floor under its k-th score, which prunes
the search of all documents; it changes no result. Items are taken in blocks of at most MAX_TERMS terms (8 MB broadcast); each block
is one pass over the texts.

Defined results: null and empty texts, and texts without terms, are no hits and count in neither N nor L; items without terms give no
rows; rows that repeat a doc_id or a text are documents each; rows that repeat an item_id are items each, ranked each on their own; a
null doc_id ranks last among equal scores; empty tables give no rows. Whole texts of any length count. Other columns are not
looked at, so their names can't clash. Terms are told apart by 64 bits of hash.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.common import cut

GAP = np.ones(256, bool)  # all ASCII but digits and letters
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    GAP[_a:_b] = False
LEAF, FAN = 32, 8
MAX_TERMS = 1 << 20  # of one block of items
MAX_ITEMS = 50_000
CELLS = 1 << 22  # values of the lowest level of one tree
_LAST = np.iinfo(np.int64).max


def _item_terms(batches):
    """item_no and the hashes of its terms, repeats included."""
    for b in batches:
        for first, data, at in T.runs(b.column(1)):
            h, row, _, _ = T.word_hashes(data, at, GAP)
            cuts = np.searchsorted(row, np.arange(len(at)))
            yield pa.record_batch([b.column(0).slice(first, len(at) - 1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))], ["item_no", "terms"])


class Block:
    """Items whose terms go to every task: sorted distinct terms, and each item's terms as places among them with counts."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        hashes = [np.array(t, np.int64).view(np.uint64) for _, t in rows]
        self.names = [i for i, _ in rows]
        self.terms = np.unique(np.concatenate(hashes))
        found = [np.unique(np.searchsorted(self.terms, h), return_counts=True) for h in hashes]
        self.places = [p for p, _ in found]
        self.counts = [c for _, c in found]


def blocks(items: DataFrame, max_terms: int = MAX_TERMS):
    """items(item_no, terms) as Blocks, one at a time on the driver; an item without terms is in none."""
    rows, size = [], 0
    for r in items.where(F.size("terms") > 0).toLocalIterator():
        if rows and (size + len(r.terms) > max_terms or len(rows) == MAX_ITEMS):
            yield Block(rows)
            rows, size = [], 0
        rows.append((r.item_no, r.terms))
        size += len(r.terms)
    if rows:
        yield Block(rows)


def _index(shared):
    """Each document's number of terms and, of the block's terms, places and occurrences."""

    def run(batches):
        terms = shared.value.terms
        for b in batches:
            for first, data, at in T.runs(b.column(1)):
                h, row, _, _ = T.word_hashes(data, at, GAP)
                size = len(at) - 1
                place = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = terms[place] == h
                key, tf = np.unique(row[hit] * len(terms) + place[hit], return_counts=True)
                owner = pa.array(np.searchsorted(key // len(terms), np.arange(size + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(owner, pa.array(x.astype(np.int32))) for x in (key % len(terms), tf)]
                yield pa.record_batch([b.column(0).slice(first, size), pa.array(np.bincount(row, minlength=size), pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m = 100 - 25 + ((25 * n * N) div L) of documents of n terms, exact at any size."""
    if 25 * docs * int(n.max(initial=0)) < _LAST:
        return 75 + 25 * docs * n // total
    return np.array([75 + 25 * docs * int(x) // total for x in n], np.int64)


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class MaxTree:
    """Per term the highest impact in each range of documents, level above level, and the postings of the lowest ranges."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        """Postings of documents 0..n_docs-1; terms are numbered anew by those that occur."""
        self.terms, t = np.unique(term, return_inverse=True)
        self.n_docs, width, ranges = n_docs, len(self.terms), -(-n_docs // LEAF)
        cell = (doc // LEAF) * width + t
        order = np.argsort(cell, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.zeros(ranges * width + 1, np.int64)
        np.cumsum(np.bincount(cell, minlength=ranges * width), out=self.at[1:])
        low = np.zeros(ranges * width, np.int64)
        np.maximum.at(low, cell, impact)
        self.levels = [np.ascontiguousarray(low.reshape(ranges, width).T)]
        while (n := self.levels[-1].shape[1]) > 1:
            padded = np.zeros((width, -(-n // FAN) * FAN), np.int64)
            padded[:, :n] = self.levels[-1]
            self.levels.append(padded.reshape(width, -1, FAN).max(2))

    def scores(self, rng: int, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Exact scores of a lowest range's documents."""
        cell = rng * len(self.terms) + place
        a = self.at[cell]
        size = self.at[cell + 1] - a
        pos = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.zeros(min(LEAF, self.n_docs - rng * LEAF), np.int64)
        np.add.at(out, self.doc[pos] - rng * LEAF, self.impact[pos] * np.repeat(count, size))
        return out

    def search(self, place: np.ndarray, count: np.ndarray, best: Best) -> int:
        """Offers `best` every document that can still be among its k; returns the number of ranges scored."""
        top = len(self.levels) - 1
        queue = [(-int(count @ self.levels[top][place, 0]), top, 0)]
        opened = 0
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound <= 0 or -bound < best.reach:
                break
            if not level:
                opened += 1
                best.offer(node * LEAF, self.scores(node, place, count))
                continue
            below = self.levels[level - 1][place, node * FAN : (node + 1) * FAN]
            for j, s in enumerate((count @ below).tolist()):
                if s > 0 and s >= best.reach:
                    heapq.heappush(queue, (-s, level - 1, node * FAN + j))
        return opened


class Best:
    """The k best (score, id) of one item so far: highest score first, then smaller id, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.reach = k, max(1, floor)
        self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def of(self, ids: np.ndarray, nulls: np.ndarray) -> Best:
        """From now on offers count from the first of these ids."""
        self.ids, self.nulls = ids, nulls
        return self

    def offer(self, first: int, scores: np.ndarray) -> None:
        got = np.flatnonzero(scores >= self.reach)
        if not len(got):
            return
        score = np.concatenate([self.score, scores[got]])
        name = np.concatenate([self.id, self.ids[first + got]])
        null = np.concatenate([self.null, self.nulls[first + got]])
        order = np.lexsort((name, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], name[order], null[order]
        if len(order) == self.k:
            self.reach = max(self.reach, int(self.score[-1]))


def _search(shared, w: np.ndarray, docs: int, total: int, floor: np.ndarray, k: int):
    """mapInArrow body: the k best of this task's documents for every item of the block."""

    def run(batches):
        block: Block = shared.value
        best = [Best(k, int(f)) for f in floor]
        step = LEAF * max(1, min(256, CELLS // len(w)))
        for b in batches:
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                owner, term = np.array(part.column(2).value_lengths()), part.column(2).flatten().to_numpy(zero_copy_only=False)
                if not len(term):
                    continue
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(owner)), owner)
                m = norms(part.column(1).to_numpy(zero_copy_only=False), docs, total)[doc]
                tree = MaxTree(len(owner), doc, term, w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m)))
                nulls = np.array(part.column(0).is_null())
                ids = part.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(tree.terms, np.arange(len(w))), len(tree.terms) - 1)
                here = tree.terms[at] == np.arange(len(w))
                for item, (place, count) in enumerate(zip(block.places, block.counts, strict=True)):
                    known = here[place]
                    if known.any():
                        tree.search(at[place[known]], count[known], best[item].of(ids, nulls))
        for name, one in zip(block.names, best, strict=True):
            if len(one.id):
                yield pa.record_batch([pa.array(np.full(len(one.id), name)), pa.array(one.id, mask=one.null), pa.array(one.score)], ["item_no", "doc_id", "score"])

    return run


_FOUND = "item_no long, doc_id long, score long"


def search(documents: DataFrame, items: DataFrame, k: int = 20, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring of documents(doc_id, text) for each row of items(item_id, text)."""
    spark = documents.sparkSession
    asked = cut(items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "text"))
    terms = cut(asked.select("item_no", "text").mapInArrow(_item_terms, "item_no long, terms array<long>"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], _FOUND)
    for block in blocks(terms, max_terms):
        shared = spark.sparkContext.broadcast(block)
        index = cut(texts.mapInArrow(_index(shared), "doc_id long, n long, terms array<int>, tfs array<int>"))
        docs, total = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not total:
            break
        df = np.zeros(len(block.terms), np.int64)
        for term, n in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most max_terms rows
            df[term] = n
        w = weights(df, docs)
        floor = np.zeros(len(block.names), np.int64)
        few = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(16)) == 0).mapInArrow(_search(shared, w, docs, total, floor, k), _FOUND)
        by = Window.partitionBy("item_no").orderBy(F.desc("score"))
        at = {name: i for i, name in enumerate(block.names)}
        for r in few.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("item_no", "score").collect():  # at most a row an item
            floor[at[r.item_no]] = r.score
        found = found.union(cut(index.mapInArrow(_search(shared, w, docs, total, floor, k), _FOUND), index))
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
