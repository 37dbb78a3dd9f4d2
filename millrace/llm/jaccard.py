"""Exact n-gram Jaccard join: rarity-ordered prefixes find groups, signature trees prune their pairs, exact sets decide.

A text's set holds its distinct k-word shingles (a text of fewer words is one shingle; without words the set is empty and is linked
with nothing). Texts link when 100 * |A & B| >= 75 * |A | B| (`percent`).

1. Every task hashes its texts' shingles and sends them, sorted and packed, to hash buckets. A bucket sees every occurrence of its
   shingles, so their exact document frequency; shingles of one text only can be in no intersection and stop here.
2. Each text gathers its shared shingles. In the order (frequency, hash), which is one and the same for all texts, linked texts
   have a shingle in common among their first |A| - ceil(t|A|) + 1. A text with that many shingles of its own can link with nothing;
   the others keep their shared shingles as their exact set, and the prefix as keys to groups. Shingles that many texts repeat
   come last in that order, so a common passage makes no group unless it is most of the text.
3. Of groups with the same texts one is kept. They are joined to components without listing pairs: tests against centres first,
   which settles copies of any number, and then, only where a group still spans several components, signature trees: leaves hold the texts' token bitmaps, nodes the
   OR of their bitmaps and the range of their sizes, and a dual traversal of the group's tree with itself drops every pair of nodes whose
   greatest possible overlap is too small for its sizes. Pairs that survive are decided on the exact sets, in the same task.

Equal texts are folded within each task before step 1, so the copies of one text cost a packed run per task, not per copy.

Defined results: null text is empty; texts with equal sets link, whatever their texts; null doc_ids take part but name no
component (a component of none but null ids is null); rows that repeat a doc_id with other text are texts of their own; an empty
table gives no rows; other columns are ignored; texts are taken whole, however long. Shingles are told apart by 48 bits of hash, texts
by 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.common import cut, distinct_groups, link_groups, n_parts, unwrapped, wrapped

FLUSH = 2_000_000
_ROW = np.uint64(0xFFFF)
_LOW16 = np.uint64(16)
_BLOB = "bucket int, flush long, a binary, b binary, c binary"
_NAMES = ["bucket", "flush", "a", "b", "c"]
SIG = 2048


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _NAMES)


def _pack(k: int, buckets: int):
    """Texts (th, text) -> packed postings per bucket, and per flush the texts' hashes and set sizes (a = th, b = n)."""

    def run(batches):
        ctx = TaskContext.get()
        flush = (ctx.partitionId() if ctx else 0) << 24
        tokens, names, known, held = [], [], set(), 0

        def out():
            nonlocal tokens, names, held, flush, known
            x = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
            doc = (x & _ROW).astype(np.int64)
            n = np.bincount(doc, minlength=len(names)).astype(np.int64)
            rows = [(-1, flush, np.array(names, np.int64).tobytes(), T.squeeze(n), b"")]
            bucket = (x >> np.uint64(40)).astype(np.int64) * buckets >> 24
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                part = x[at[b] : at[b + 1]]
                if len(part):
                    rows.append((b, flush, T.squeeze_sorted(part >> _LOW16), T.squeeze((part & _ROW).astype(np.uint16)), b""))
            flush += 1
            tokens, names, known, held = [], [], set(), 0
            return _batch(rows)

        for b in batches:
            th = b.column(0).to_numpy(zero_copy_only=False)
            text = b.column(1)
            for lo in range(0, len(b), 1024):
                fresh = []
                for i in range(lo, min(len(b), lo + 1024)):
                    if th[i] not in known:
                        known.add(th[i])
                        fresh.append(i)
                if not fresh:
                    continue
                for first, data, at in T.runs(text.take(pa.array(fresh))):
                    n = len(at) - 1
                    if len(names) + n > 65_000:
                        yield out()
                    h, row, _, _ = T.word_hashes(data, at)
                    s, srow, _ = T.shingles(h, row, n, k)
                    tokens.append((s & ~_ROW) | (srow + len(names)).astype(np.uint64))
                    names.extend(th[fresh[first : first + n]].tolist())
                    known.update(names[-n:])
                    held += len(s)
                    if held >= FLUSH:
                        yield out()
        if names:
            yield out()

    return run


def _shared(batches):
    """Packed postings of some buckets -> per flush, those of shingles that several texts have, with their frequency."""
    blobs: dict[int, list] = {}
    for b in batches:
        rows = b.to_pylist()
        meta = [(r["bucket"], r["flush"], r["a"], r["b"], r["c"]) for r in rows if r["bucket"] < 0]
        if meta:
            yield _batch(meta)
        for r in rows:
            if r["bucket"] >= 0:
                blobs.setdefault(r["bucket"], []).append((r["flush"], r["a"], r["b"]))
    for bucket in sorted(blobs):
        parts = sorted(blobs.pop(bucket))
        hs = [T.unsqueeze_sorted(a) for _, a, _ in parts]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(h) for h in hs])
        h = np.concatenate(hs)
        del hs
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        doc = np.concatenate([T.unsqueeze(b) for _, _, b in parts])[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.diff(np.append(new, len(h)))
        many = np.repeat(df > 1, df)
        freq = np.minimum(np.repeat(df, df)[many], 0xFFFFFFFF).astype(np.uint32)
        h, owner, doc = h[many], owner[many], doc[many]
        by = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[by], np.arange(len(parts) + 1))
        for i, (flush, _, _) in enumerate(parts):
            on = by[at[i] : at[i + 1]]
            if len(on):
                yield _batch([(bucket, flush, T.squeeze_sorted(h[on]), T.squeeze(doc[on]), T.squeeze(freq[on]))])


def _sets(percent: int):
    """A flush's shared postings -> (th, n, shared count, set, prefix, signature); set is null where nothing can link."""
    names = ["th", "n", "c", "set", "prefix", "sig"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["flush"], []).append((r["bucket"], r["a"], r["b"], r["c"]))
        for flush in sorted(held):
            rows = sorted(held.pop(flush), key=lambda r: r[0])
            th, n = np.frombuffer(rows[0][1], np.int64), T.unsqueeze(rows[0][2]).view(np.int64)
            parts = rows[1:]
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            h = cat([T.unsqueeze_sorted(a) for _, a, _, _ in parts], np.uint64)
            doc = cat([T.unsqueeze(b) for _, _, b, _ in parts], np.uint16).astype(np.int64)
            freq = cat([T.unsqueeze(c) for _, _, _, c in parts], np.uint32)
            count = np.bincount(doc, minlength=len(th))
            need = -(-percent * n // 100)
            own = n - count
            prefix = n - need + 1 - own
            can = (prefix > 0) & (n > 0)
            live = can[doc]
            h, doc, freq = h[live], doc[live], freq[live]
            order = np.lexsort((h, doc))
            h, doc, freq = h[order], doc[order], freq[order]
            at = np.searchsorted(doc, np.arange(len(th) + 1))
            bit = (T.mix(h) >> np.uint64(53)).astype(np.int64)
            out = [[] for _ in names]
            for i in range(len(th)):
                row = (int(th[i]), int(n[i]), int(count[i]), None, None, None)
                if can[i]:
                    a, z = at[i], at[i + 1]
                    s = h[a:z]
                    first = np.lexsort((s, freq[a:z]))[: prefix[i]]
                    bits = np.zeros(SIG, np.uint8)
                    bits[bit[a:z]] = 1
                    six = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    row = (*row[:3], six, s[first].view(np.int64), np.packbits(bits).tobytes())
                for o, v in zip(out, row, strict=True):
                    o.append(v)
                if len(out[0]) == 2048 or i == len(th) - 1:
                    yield pa.record_batch([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)
                    out = [[] for _ in names]

    return run


def _unset(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


_SETS = "th long, n long, c int, set binary, prefix array<long>, sig binary"


def _once(batches):
    """The first row of every text hash of a partition: rows of one text are equal."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for i, th in enumerate(b.column(0).to_pylist()):
            if th not in seen:
                seen.add(th)
                keep.append(i)
        if keep:
            yield b.take(pa.array(keep)) if len(keep) < len(b) else b


def _exact(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for na, nb, sa, sb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                common = len(np.intersect1d(_unset(sa), _unset(sb), assume_unique=True))
                ok.append(100 * common >= percent * (na + nb - common))
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class SignatureTree:
    """Nodes over texts sorted by set size: OR-combined bitmaps, size ranges, and the most shingles a bitmap may hide."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, extra: np.ndarray, comp: np.ndarray, leaf: int = 8, fan: int = 8):
        self.levels = []  # from the leaves up: first member, last member + 1, lo, hi, bitmap, extra
        at = np.append(np.arange(0, len(n), leaf), len(n)).astype(np.int64)
        self.n, self.sig, self.extra, self.comp = n, sig, extra, comp
        lo, hi, ex, bits = n[at[:-1]], n[at[1:] - 1], np.maximum.reduceat(extra, at[:-1]), np.bitwise_or.reduceat(sig, at[:-1], axis=0)
        one = np.minimum.reduceat(comp, at[:-1]), np.maximum.reduceat(comp, at[:-1])
        while True:
            self.levels.append((at, lo, hi, bits, ex, one))
            if len(lo) == 1:
                return
            up = np.arange(0, len(lo), fan)
            at = np.append(at[up], at[-1])
            lo, hi = np.minimum.reduceat(lo, up), np.maximum.reduceat(hi, up)
            ex, bits = np.maximum.reduceat(ex, up), np.bitwise_or.reduceat(bits, up, axis=0)
            one = np.minimum.reduceat(one[0], up), np.maximum.reduceat(one[1], up)

    @staticmethod
    def may(lo1, hi1, bits1, ex1, lo2, hi2, bits2, ex2, percent: int) -> np.ndarray:
        """False where no members of the two nodes can reach the similarity."""
        overlap = np.bitwise_count(bits1 & bits2).sum(1).astype(np.int64) + np.minimum(ex1, ex2)
        sizes = (100 * np.minimum(hi1, hi2) >= percent * np.maximum(lo1, lo2)) & (100 * hi1 >= percent * lo2) & (100 * hi2 >= percent * lo1)
        return sizes & ((100 + percent) * overlap >= percent * (lo1 + lo2))

    def pairs(self, percent: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Members i < j of different components that may link, by dual traversal from the root."""
        i = j = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            at, lo, hi, bits, ex, (c0, c1) = self.levels[depth]
            keep = self.may(lo[i], hi[i], bits[i], ex[i], lo[j], hi[j], bits[j], ex[j], percent) & ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
            i, j = i[keep], j[keep]
            if depth:
                size = len(self.levels[depth - 1][1])
                kid = np.arange(fan)
                a, b = (i[:, None] * fan + kid)[:, :, None], (j[:, None] * fan + kid)[:, None, :]
                a, b = (x.reshape(-1) for x in np.broadcast_arrays(a, b))
                ok = (a < size) & (b < size) & (a <= b)
                i, j = a[ok], b[ok]
        at = self.levels[0][0]
        out_i, out_j = [], []
        for x, y in zip(i, j, strict=True):
            a, b = np.arange(at[x], at[x + 1]), np.arange(at[y], at[y + 1])
            a, b = (v.reshape(-1) for v in np.broadcast_arrays(a[:, None], b[None, :]))
            ok = (a < b) & (self.comp[a] != self.comp[b])
            a, b = a[ok], b[ok]
            ok = self.may(self.n[a], self.n[a], self.sig[a], self.extra[a], self.n[b], self.n[b], self.sig[b], self.extra[b], percent)
            out_i.append(a[ok])
            out_j.append(b[ok])
        z = np.zeros(0, np.int64)
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (z, z)


def _tree_links(percent: int):
    """Groups' members -> links between different components, enough of them to join all components that the group's links join.

    Pairs that survive the trees are decided on the exact sets, unless links found before (in any group of this task) have joined
    their components already. Failed pairs are remembered, as texts meet in many groups; that memory is a cache of fixed size.
    """

    def run(batches):
        parent: dict[int, int] = {}
        failed: set[tuple[int, int]] = set()

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for b in batches:
            out = []
            for m in b.column(0):
                m = m.as_py()
                m.sort(key=lambda r: (r["n"], r["id"]))
                ids, n, comp = [r["id"] for r in m], np.array([r["n"] for r in m]), [r["comp"] for r in m]
                sig = np.frombuffer(b"".join(r["sig"] for r in m), np.uint64).reshape(len(m), -1)
                extra = np.array([r["c"] for r in m]) - np.bitwise_count(sig).sum(1)
                sets: dict[int, np.ndarray] = {}
                for i, j in zip(*(x.tolist() for x in SignatureTree(n, sig, extra, np.array(comp)).pairs(percent)), strict=True):
                    ci, cj, key = find(comp[i]), find(comp[j]), (ids[i], ids[j])
                    if ci == cj or key in failed:
                        continue
                    for x in (i, j):
                        if x not in sets:
                            sets[x] = _unset(m[x]["set"])
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (int(n[i]) + int(n[j]) - common):
                        parent[ci] = cj
                        out.append(key)
                    elif len(failed) < 1_000_000:
                        failed.add(key)
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def components(docs: DataFrame, k: int = 5, percent: int = 75, chunk: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(th, n) of every distinct text, and (id, component) of the texts with a link; th and id are text hashes."""
    parts = n_parts(docs.sparkSession)
    buckets = max(parts, 16)
    base = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    packed = base.mapInArrow(_pack(k, buckets), _BLOB)
    to = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("flush"), F.lit(parts))).otherwise(F.col("bucket") % parts).cast("int")
    shared = packed.repartitionById(parts, to).mapInArrow(_shared, _BLOB)
    sets = shared.repartition(parts, "flush").mapInArrow(_sets(percent), _SETS)
    sets = cut(sets.repartition(parts, "th").mapInArrow(_once, _SETS))
    able = sets.where("set is not null")
    members = cut(able.select(F.explode("prefix").alias("g"), F.col("th").alias("id")))
    sides = [able.select(F.col("th").alias(x), F.col("n").alias(f"n{x}"), F.col("set").alias(f"s{x}")) for x in "ab"]

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_exact(percent), "a long, b long")

    def cross(rows: DataFrame) -> DataFrame:
        """Links between components; a group of many bytes is dealt in pairs of parts of about `chunk` bytes."""
        info = able.select(F.col("th").alias("id"), "n", "c", "sig", "set")
        size = able.select(F.col("th").alias("id"), (F.length("set") + SIG // 8 + 64).alias("b"))
        many = rows.join(size, "id").groupBy("g").agg(F.ceil(F.sum("b") / chunk).cast("int").alias("parts"))
        m = rows.join(many, "g").withColumn("part", F.pmod(F.hash("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = ("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        one = F.struct("id", "comp", "n", "c", "sig", "set")
        lists = m.join(info, "id").groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("m"))  # at most two parts
        return lists.select("m").mapInArrow(_tree_links(percent), "a long, b long")

    groups = cut(distinct_groups(members), members)
    comp = link_groups(groups, verify, cross, rounds=2)
    return sets.select("th", "n"), comp


def report(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) for every row."""
    sizes, comp = components(docs, k, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(sizes, "th").join(comp.withColumnRenamed("id", "th"), "th", "left").withColumn("c", F.coalesce("component", "th"))
    least = rows.groupBy("c").agg(F.min("doc_id").alias("m"))
    return rows.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("m")).alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id, then text hash; rows without words all stay.

    Rows that repeat both doc_id and text are one document and share its fate.
    """
    sizes, comp = components(docs, k, percent)
    key = {"k": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)), "x": F.col("row.doc_id").isNull(), "th": F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))}
    named = wrapped(docs).withColumns(key)
    who = named.select(*key).join(sizes, "th").where("n > 0").join(comp.toDF("th", "component"), "th", "left").withColumn("c", F.coalesce("component", "th"))
    best = who.groupBy("c").agg(F.min(F.struct("x", "k", "th")).alias("m"), F.count("*").alias("rows")).where("rows > 1").select("c", "m")
    lost = who.join(best, "c").where(F.struct("x", "k", "th") != F.col("m")).select(*key).distinct()
    return unwrapped(named.join(lost, list(key), "left_anti"), docs.columns)
