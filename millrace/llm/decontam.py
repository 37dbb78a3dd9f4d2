"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters, digits and bytes over 127, so punctuation and line breaks don't hide a copy. Items are met
in blocks of at most `block_items`, whose seeds (word trigrams) are shipped to every task; one pass over the texts per block finds
the seeds and takes the words around each diagonal they lie on. Every such window counts, however common its seeds are: one that
holds too few of its item's words to reach `min_score` is left out (an upper bound, so nothing is lost), every other one is aligned
with its item, word by word, with linear gap costs, and scores (matches - penalties) / item words. A document's verdict depends on
its own text and the items alone, not on the other documents.

Defined results: null or empty texts and items match nothing; items under `min_words` words are too short to tell and match nothing;
repeated items give a row each; documents that repeat text are scored alike; an empty table on either side gives no rows; of equal
scores in one document the earliest window counts; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.quality import GAP

SEED = 3
MATCH, MISMATCH, OPEN = 1.0, -0.5, -0.5


class Items:
    """A block of benchmark items as word hashes with their seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int):
        self.ids, self.words = np.array(ids, np.int64), []
        seeds, item, at = [], [], []
        for k, t in enumerate(texts):
            h, row, _, _ = _hash(pa.array([t], pa.string()))
            self.words.append(h)
            if len(h) < min_words:
                continue
            s, _, first = T.shingles(h, row, 1, SEED, whole=False)
            seeds.append(s)
            item.append(np.full(len(s), k))
            at.append(first)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seeds, item, at = join(seeds, np.uint64), join(item, np.int64), join(at, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.item, self.at = item[order], at[order]
        self.seed, self.first = np.unique(seeds[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))


def _hash(column: pa.Array):
    for _, data, at in T.runs(column, 1 << 62):
        return T.word_hashes(data, at, GAP)
    z = np.zeros(0, np.int64)
    return z.astype(np.uint64), z, z, z


def find(column: pa.Array, items: Items):
    """(row, item index, first word, words) for every diagonal band of every row that holds a seed."""
    for first_row, data, offs in T.runs(column):
        n = len(offs) - 1
        h, row, _, _ = T.word_hashes(data, offs, GAP)
        s, srow, sat = T.shingles(h, row, n, SEED, whole=False)
        if not len(s) or not len(items.seed):
            continue
        k = np.minimum(np.searchsorted(items.seed, s), len(items.seed) - 1)
        hit = np.flatnonzero(items.seed[k] == s)
        if not len(hit):
            continue
        k = k[hit]
        count = items.count[k]
        base = np.repeat(items.first[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, r, pos = items.item[base], np.repeat(srow[hit], count), np.repeat(sat[hit], count)
        diag = pos - items.at[base]
        order = np.lexsort((diag, item, r))
        item, r, diag = item[order], r[order], diag[order]
        size = np.array([len(w) for w in items.words])
        start_of = np.searchsorted(row, np.arange(n + 1))
        i = 0
        key = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1])))
        for a, b in zip(key, np.append(key[1:], len(r)), strict=True):
            m, i = size[item[a]], a
            while i < b:
                j = i + int(np.searchsorted(diag[i:b], diag[i] + m, "right"))
                lo = max(int(start_of[r[a]]), int(diag[i]) - m // 2)
                hi = min(int(start_of[r[a] + 1]), int(diag[j - 1]) + m + m // 2)
                yield first_row + int(r[a]), int(item[a]), lo - int(start_of[r[a]]), h[lo:hi]
                i = j


def align(item: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of one item against a batch of windows (rows padded past their length), linear gaps."""
    n, w = windows.shape
    best = np.zeros(n)
    prev = np.zeros((n, w + 1))
    ramp = -OPEN * np.arange(w + 1)
    inside = np.arange(1, w + 1)[None, :] <= lengths[:, None]
    for word in item:
        now = np.zeros((n, w + 1))
        now[:, 1:] = np.maximum(prev[:, :-1] + np.where((windows == word) & inside, MATCH, MISMATCH), prev[:, 1:] + OPEN)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, 1) - ramp  # gaps along the window: a running maximum
        best = np.maximum(best, now.max(1))
        prev = now
    return best


def scores(found: list, items: Items) -> np.ndarray:
    """Score of each candidate (row, item index, first word, words) of `found`, batched by item."""
    item, got = np.array([f[1] for f in found]), np.zeros(len(found))
    for k in np.unique(item):
        target, at = items.words[k], np.flatnonzero(item == k)
        for c in range(0, len(at), 256):
            some = [found[i][3] for i in at[c : c + 256]]
            lengths = np.array([len(x) for x in some])
            box = np.zeros((len(some), max(1, lengths.max(initial=0))), np.uint64)
            for i, x in enumerate(some):
                box[i, : len(x)] = x
            got[at[c : c + 256]] = align(target, box, lengths) / len(target)
    return got


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, min_words: int = 5, block_items: int = 20_000) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word: one row per document and item it holds a copy of, edited or not."""
    spark = docs.sparkSession
    total = benchmark.count()
    blocks = max(1, -(-total // block_items))
    out = None
    for b in range(blocks):
        part = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
        part = part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else part
        got = part.orderBy("item_id", "text").toPandas()  # about block_items rows
        one = _block(docs, Items([-1 if x != x else int(x) for x in got.item_id], list(got.text), min_words), min_score)
        out = one if out is None else out.unionByName(one)
    return out


def _block(docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def seek(batches):
        own = shared.value
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                # An alignment has at most one match for each item word that stands in the window.
                found = [f for f in find(part.column(2), own) if MATCH * np.isin(own.words[f[1]], f[3]).sum() >= min_score * len(own.words[f[1]])]
                if not found:
                    continue
                got = scores(found, own)
                keep = np.flatnonzero(got >= min_score)
                rows = pa.array([found[i][0] for i in keep], pa.int64())
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(own.ids[np.array([found[i][1] for i in keep], np.int64)], pa.int64()), pa.array(got[keep]), pa.array([found[i][2] for i in keep], pa.int32())], ["doc_id", "text_hash", "item_id", "score", "first_word"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    scored = base.mapInArrow(seek, "doc_id long, text_hash long, item_id long, score double, first_word int")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("neg"))).alias("m")
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "m.score", (-F.col("m.neg")).alias("first_word"))
