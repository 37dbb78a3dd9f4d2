"""Removal of long repeated byte strings, found by a logarithmic family of suffix arrays.

A window is a string of `size` bytes (400) inside one text; every byte under a window that also starts elsewhere goes. Texts are cut
into segments by content: each window names as anchor its leftmost k-gram of least hash, and a segment is a run of neighbouring
windows with one anchor. Equal windows name equal anchors at equal offsets, so windows need to be compared within one anchor's
group only. Three steps follow, each exact on that ground:

1. Segments that occur twice as a whole are repeated whole; they are counted by (anchor, segment) hash with partial sums, which
   folds copies of any number into one row a task.
2. Of anchors with several different segments, one instance of each segment is sent, as text, to the anchor's partition. There the
   arrivals form batches; each batch gets a suffix array (prefix doubling), neighbours with `size` bytes in common are repeated,
   and the batch's windows are merge-scanned against the existing levels of the index; levels of equal size merge geometrically, so
   a window is moved O(log n) times. Matches across levels are found by fingerprint and compared byte by byte.
3. Each text gathers its ranges and drops their union.

Defined results: null text is empty; texts shorter than `size` keep all bytes; matches never cross texts, but may overlap within
one; rows repeating a text are each other's copies, whatever their ids (null ids included); an empty table gives no rows; other
columns are ignored. Windows are told apart by 64-bit hashes in step 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.common import cut, n_parts

K = 40
_SLICE, _PLACE = 1 << 22, np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every full window: block-wise running minima from both sides."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    block = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(block, 1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, at: np.ndarray, size: int):
    """(row, first window, last window, anchor hash, segment hash) of a run's segments; windows count from their row's start."""
    w = size - K + 1
    prefix = T.prefix_hash(data)
    out = []
    for lo in range(0, max(0, len(data) - size + 1), _SLICE):
        hi = min(len(data) - size + 1, lo + _SLICE)
        grams = np.arange(lo, hi + w - 1)
        key = (T.span_hash(prefix, grams, grams + K) & ~_PLACE) | (grams - lo).astype(np.uint64)
        anchor = lo + (_sliding_min(key, w) & _PLACE).astype(np.int64)
        out.append(anchor)
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    anchor = np.concatenate(out)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    whole = start + size <= at[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(start) else start
    end = np.append(new[1:], len(start)) - 1
    first, last, anchor, row = start[new], start[end] if len(start) else start, anchor[new], row[new]
    return row, first - at[row], last - at[row], T.span_hash(prefix, anchor, anchor + K), T.span_hash(prefix, first, last + size)


_IDX = np.uint64(21)
_ONES = np.uint64((1 << 21) - 1)
MAX_BATCH = (1 << 21) - 1024


def window_classes(text: np.ndarray, size: int) -> np.ndarray:
    """Rank of the `size`-byte window at each position among all of the text's, by prefix doubling; the text's end counts as zeros.

    A round sorts plain integers: rank, rank of what follows, and position, 21 bits each, so a batch holds under 2**21 bytes.
    """
    n = len(text)
    if n > MAX_BATCH + 1000:
        raise ValueError("batch too large for packed ranks")
    rank = text.astype(np.uint64) << np.uint64(8)
    rank[:-1] |= text[1:]
    place = np.arange(n, dtype=np.uint64)
    have = min(2, size)
    while have < size:
        step = min(have, size - have)
        key = (rank << (_IDX + _IDX)) | place
        key[: n - step] |= (rank[step:] + np.uint64(1)) << _IDX
        key.sort()
        pair = key >> _IDX
        new = np.zeros(n, np.uint64)
        np.cumsum(pair[1:] != pair[:-1], out=new[1:], dtype=np.uint64)
        rank[(key & _ONES).astype(np.int64)] = new
        have += step
    return rank


class LogIndex:
    """Levels of windows sorted by fingerprint; level i holds about 2**i batches. A window stands for all its equals."""

    def __init__(self, size: int):
        self.size = size
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []  # fingerprint, global place, repeated
        self.texts: list[np.ndarray] = []
        self.ends: list[int] = [0]

    def _bytes(self, place: np.ndarray) -> np.ndarray:
        out = np.empty((len(place), self.size), np.uint8)
        batch = np.searchsorted(self.ends, place, "right") - 1
        for b in np.unique(batch):
            on = batch == b
            out[on] = self.texts[b][(place[on] - self.ends[b])[:, None] + np.arange(self.size)]
        return out

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        """Index a batch: text and the places of its windows."""
        base = self.ends[-1]
        self.texts.append(text)
        self.ends.append(base + len(text))
        rank = window_classes(text, self.size)[starts]
        _, first, count = np.unique(rank, return_index=True, return_counts=True)
        prefix = T.prefix_hash(text)
        place = starts[first]
        mark = T.span_hash(prefix, place, place + self.size)
        order = np.argsort(mark, kind="stable")
        new = (mark[order], place[order] + base, (count > 1)[order])
        for level in self.levels:
            if level is not None:
                self._scan(new, level)
        i = 0
        while i < len(self.levels) and self.levels[i] is not None:  # equal sizes merge, as in a binary counter
            old = self.levels[i]
            merged = [np.concatenate([a, b]) for a, b in zip(new, old, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            new = tuple(x[order] for x in merged)
            self.levels[i] = None
            i += 1
        if i == len(self.levels):
            self.levels.append(None)
        self.levels[i] = new

    def _scan(self, new, level) -> None:
        at = np.searchsorted(level[0], new[0])
        at[at == len(level[0])] = 0
        hit = np.flatnonzero(level[0][at] == new[0])
        for lo in range(0, len(hit), 8192):
            some = hit[lo : lo + 8192]
            same = (self._bytes(new[1][some]) == self._bytes(level[1][at[some]])).all(1)
            new[2][some[same]] = True
            level[2][at[some[same]]] = True

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints of all windows that occur at least twice."""
        got = [level[0][level[2]] for level in self.levels if level is not None]
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _union(ranges: np.ndarray) -> np.ndarray:
    """Sorted disjoint maximal runs of [from, to) rows; touching runs join."""
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    top = np.maximum.accumulate(r[:, 1])
    new = np.flatnonzero(np.append(True, r[1:, 0] > top[:-1]))
    return np.stack([r[new, 0], top[np.append(new[1:], len(r)) - 1]], 1)


def repeats(docs: DataFrame, size: int = 400, batch_bytes: int = MAX_BATCH) -> DataFrame:
    """k, th (row key), ranges array<struct<from, to>>: what goes, per text with anything to remove."""
    base = _keyed(docs)

    def find(batches):
        for b in batches:
            k, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(b), 1024):
                for first, data, at in T.runs(b.column(2).slice(lo, 1024)):
                    row, s, e, ah, sh = segments(data, at, size)
                    row = row + first + lo
                    yield pa.record_batch([pa.array(k[row]), pa.array(th[row]), pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["k", "th", "ah", "sh", "s", "e"])

    segs = base.mapInArrow(find, "k long, th long, ah long, sh long, s int, e int")
    kinds = cut(segs.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "s", "e")).alias("one")).withColumn("n", F.least("n", F.lit(2)).cast("byte")))
    whole = kinds.where("n > 1").select("ah", "sh")
    mixed = kinds.groupBy("ah").agg(F.count("*").alias("m")).where("m > 1").select("ah")
    covered = segs.join(whole, ["ah", "sh"], "left_semi").select("k", "th", F.col("s").alias("from"), (F.col("e") + size).alias("to"))
    ask = kinds.join(mixed, "ah", "left_semi").select("one.k", "one.th", F.struct("ah", "sh", "n", "one.s", "one.e").alias("q"))

    parts = n_parts(docs.sparkSession)

    def texts(batches):
        """Packs the segments asked for, per partition of their anchors."""
        for b in batches:
            to: dict[int, tuple] = {}
            for k, th, q, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = t.encode()
                for x in q:
                    meta, body = to.setdefault(x["ah"] % parts, ([], []))
                    meta.append((k, th, x["s"], x["e"], x["n"]))
                    body.append(raw[x["s"] : x["e"] + size])
            rows = [(p, np.array(meta, np.int64).tobytes(), T._zip.compress(b"".join(body))) for p, (meta, body) in to.items()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "meta", "body"])

    asked = ask.groupBy("k", "th").agg(F.collect_list("q").alias("q"))  # one row per text, as long as the text at most
    # Repeated rows send their segments twice, which is harmless: those are repeated whole, and only single ones are asked about.
    sent = base.join(asked, ["k", "th"]).select("k", "th", "q", "text").mapInArrow(texts, "part int, meta binary, body binary")

    def examine(batches):
        index, rows = LogIndex(size), []
        buf, starts, held = [], [], 0

        def flush():
            nonlocal buf, starts, held
            if buf:
                index.add(np.frombuffer(b"".join(buf), np.uint8), np.concatenate(starts))
            buf, starts, held = [], [], 0

        for b in batches:
            for _, meta, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body, at = T._unzip.decompress(body), 0
                for k, th, s, e, n in np.frombuffer(meta, np.int64).reshape(-1, 5).tolist():
                    t = body[at : at + e - s + size]
                    at += len(t)
                    if held + len(t) > batch_bytes:
                        flush()
                    buf.append(t)
                    starts.append(held + np.arange(e - s + 1))
                    held += len(t)
                    if n == 1:
                        rows.append((k, th, s, e, t))
        flush()
        twice = index.repeated()
        out = ([], [], [], [])
        for k, th, s, e, t in rows:
            at = np.arange(e - s + 1)
            mark = T.span_hash(T.prefix_hash(np.frombuffer(t, np.uint8)), at, at + size)
            place = np.minimum(np.searchsorted(twice, mark), max(0, len(twice) - 1))
            on = np.flatnonzero(twice[place] == mark) if len(twice) else at[:0]
            if len(on):
                for a, z in _union(np.stack([s + on, s + on + size], 1)):
                    for o, v in zip(out, (k, th, int(a), int(z)), strict=True):
                        o.append(v)
        if out[0]:
            yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k", "th", "from", "to"])

    partial = sent.repartitionById(parts, F.col("part")).mapInArrow(examine, "k long, th long, from int, to int")
    return cut(covered.unionByName(partial).groupBy("k", "th").agg(F.collect_set(F.struct("from", "to")).alias("ranges")), kinds)


def _keyed(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"), *extra)


def digest(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what remains, without characters cut in two) for every row."""
    gone = repeats(docs, size)
    joined = _keyed(docs, ("doc_id",)).join(gone, ["k", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def keep(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode()
                spans = _union(np.array([(x["from"], x["to"]) for x in r], np.int64)).tolist() if r else []
                kept, at = [], 0
                for a, z in spans:
                    kept.append(raw[at:a])
                    at = z
                kept = b"".join([*kept, raw[at:]]) if spans else raw
                for o, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if spans else t), strict=True):
                    o.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names)

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
