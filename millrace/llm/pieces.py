"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

The piece lattice of a text has an edge for every piece that matches at a byte, and one byte-fallback edge for every byte. A path's
weight is the product of its pieces' weights to the power `theta`. Forward filtering sums the weights of all paths up to each byte;
backward sampling then draws pieces from the end, each with its exact posterior probability. The draws are a hash of the seed, the
row's key and the byte's position, so a row's segmentation is the same in any run, on any machine and in any partitioning.

No piece holds a blank after another character, and some bytes occur in no piece longer than themselves, so the lattice falls apart
into units there (exactly: the product over units is the whole lattice's law). Equal units share one filtering pass, and
all units of about one length are filtered and sampled as one array.

A piece model made for merges carries no probabilities; pieces then weigh 1 / (rank + 10), byte edges e**-10 times the least of
these (as the format's own penalty for unknown characters).

Defined results: null text encodes to null, empty text to no ids; a null key draws like key 0; a blank is written in front of every
text and removed by decoding; U+2581 in a text is kept apart from a blank by byte edges; texts of any length are taken whole, and
units over 64 bytes are filtered one by one; repeated rows with one key and text give equal ids; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import textops as T

CAPS = (8, 16, 32, 64)
BLANK = "▁"


class Pieces:
    """Piece table: bytes by id, log weights, and a hash lookup. Blanks stand as 0x20."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: dict[int, int], theta: float = 1.0):
        size = max([*(i for i, _, _ in pieces), *byte_ids.values()]) + 1
        self.text = [b""] * size
        for i, b, _ in pieces:
            self.text[i] = b
        for b, i in byte_ids.items():
            self.text[i] = bytes([b])
        self.length = np.array([len(b) for b in self.text], np.int64)
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.offset = np.cumsum(self.length) - self.length
        least = min(w for _, _, w in pieces) - 10
        self.byte_id = np.full(256, -1, np.int32)
        for b, i in byte_ids.items():
            self.byte_id[b] = i
        self.byte_weight = theta * least
        self.longest = max(len(b) for _, b, _ in pieces)
        inner = {c for _, b, _ in pieces for c in b}
        self.lone = np.array([c not in inner for c in range(256)])
        if any(b" " in b.lstrip(b" ") for _, b, _ in pieces):
            raise ValueError("a piece holds a blank after another character")
        data = np.frombuffer(b"".join(b for _, b, _ in pieces), np.uint8)
        ends = np.cumsum([len(b) for _, b, _ in pieces])
        keys = T.span_hash(T.prefix_hash(data), ends - np.array([len(b) for _, b, _ in pieces]), ends)
        self.key = np.append(keys, np.uint64(0))
        self.id = np.append(np.array([i for i, _, _ in pieces], np.int32), np.int32(-1))
        self.weight = np.append(np.array([theta * w for _, _, w in pieces]), -np.inf)
        none, left, self.tables = len(keys), np.arange(len(keys)), []
        for shift in (44, 22, 2, 33, 11):  # tables hold what the ones before had no free slot for
            table = np.full(1 << 20, none, np.int32)
            slot = ((keys[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            self.tables.append((np.uint64(shift), table))
            left = np.delete(left, first)
            if not len(left):
                break
        else:
            raise ValueError("pieces hash alike")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index into key, id and weight; the last index where no piece has this hash."""
        out = np.full(h.shape, len(self.key) - 1, np.int32)
        for shift, table in self.tables:
            got = table[((h >> shift) & np.uint64((1 << 20) - 1)).astype(np.int64)]
            np.copyto(out, got, where=self.key[got] == h)
        return out


def load(path: str, theta: float = 1.0) -> Pieces:
    """Pieces of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], {}
    for i in range(sp.vocab_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((i, sp.id_to_piece(i).replace(BLANK, " ").encode(), float(-np.log(len(pieces) + 10))))
    return Pieces(pieces, byte_ids, theta)


def _uniform(key: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = T.mix(T.mix(key + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) ^ (at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _filter(p: Pieces, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward filtering of distinct units: per unit, end byte and piece length, the cumulative posterior and the piece id."""
    n, wide = len(start), min(cap, p.longest)
    cdf = np.full((n, cap + 1, wide), 2, np.float32)
    ids = np.full((n, cap + 1, wide), -1, np.int32)
    total = np.full((n, cap + 1), -np.inf)
    total[:, 0] = 0
    for pos in range(1, cap + 1):
        on = np.flatnonzero(size >= pos)
        if not len(on):
            break
        m = min(pos, wide)
        end = start[on] + pos
        back = np.arange(1, m + 1)
        h = T.span_hash(prefix, end[:, None] - back[None, :], np.broadcast_to(end[:, None], (len(on), m)))
        k = p.find(h)
        w, i = p.weight[k], p.id[k]
        last = data[end - 1]
        as_byte = i[:, 0] < 0  # a one-byte piece stands before the byte edge of its byte
        w[as_byte, 0], i[as_byte, 0] = p.byte_weight, p.byte_id[last[as_byte]]
        x = w + total[on][:, pos - back]
        top = x.max(1)
        e = np.exp(x - top[:, None])
        sums = e.sum(1)
        total[on, pos] = top + np.log(sums)
        cdf[on, pos, :m] = np.cumsum(e, 1) / sums[:, None]
        ids[on, pos, :m] = i
    return cdf, ids


def _sample_long(p: Pieces, data: np.ndarray, prefix: np.ndarray, start: int, size: int, key: np.uint64, base: int, seed: int) -> list[int]:
    """One unit of any length, by the same law."""
    back = np.arange(1, min(size, p.longest) + 1)
    total = np.full(size + 1, -np.inf)
    total[0] = 0
    steps = []
    for pos in range(1, size + 1):
        b = back[:pos]
        k = p.find(T.span_hash(prefix, start + pos - b, np.full(len(b), start + pos)))
        w, i = p.weight[k], p.id[k]
        if i[0] < 0:
            w[0], i[0] = p.byte_weight, p.byte_id[data[start + pos - 1]]
        x = w + total[pos - b]
        e = np.exp(x - x.max())
        total[pos] = x.max() + np.log(e.sum())
        steps.append((np.cumsum(e) / e.sum(), i))
    out, pos = [], size
    u = _uniform(np.full(size + 1, key), base + np.arange(size + 1), seed)
    while pos:
        c, i = steps[pos - 1]
        b = min(int((c < u[pos]).sum()), len(c) - 1)
        out.append(int(i[b]))
        pos -= b + 1
    return out[::-1]


def encode_run(p: Pieces, data: np.ndarray, at: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of all rows of a run, one after the other, and where each row's begin. Rows start with their written blank."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    prefix = T.prefix_hash(data)
    blank, lone = data == 32, p.lone[data]
    cutp = np.empty(len(data), bool)
    cutp[0] = True
    cutp[1:] = (blank[1:] & ~blank[:-1]) | lone[1:] | lone[:-1]
    cutp[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(cutp)
    size = np.diff(np.append(start, len(data)))
    row = np.searchsorted(at, start, "right") - 1
    unit = T.span_hash(prefix, start, start + size)
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, place from its end, id
    count = np.zeros(len(start), np.int64)
    low = 0
    for cap in CAPS:
        here = np.flatnonzero((size > low) & (size <= cap))
        low = cap
        if not len(here):
            continue
        _, first, which = np.unique(unit[here], return_index=True, return_inverse=True)
        step = max(1, (1 << 22) // ((cap + 1) * min(cap, p.longest)))
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(0, len(first) + step, step))
        for c in range(0, len(first), step):
            some = here[first[c : c + step]]
            cdf, ids = _filter(p, data, prefix, start[some], size[some], cap)
            occ = order[bounds[c // step] : bounds[c // step + 1]]
            u, at_unit = which[occ] - c, here[occ]
            pos, depth = size[at_unit].copy(), 0
            while len(at_unit):
                r = _uniform(keys[row[at_unit]], start[at_unit] - at[row[at_unit]] + pos, seed)
                table = cdf[u, pos]
                b = np.minimum((table < r[:, None]).sum(1), np.minimum(pos, table.shape[1]) - 1)
                pieces.append((at_unit, np.full(len(at_unit), depth), ids[u, pos, b]))
                count[at_unit] += 1
                pos = pos - b - 1
                go = pos > 0
                u, at_unit, pos, depth = u[go], at_unit[go], pos[go], depth + 1
    for k in np.flatnonzero(size > CAPS[-1]):
        got = _sample_long(p, data, prefix, int(start[k]), int(size[k]), keys[row[k]], int(start[k] - at[row[k]]), seed)
        pieces.append((np.full(len(got), k), np.arange(len(got))[::-1], np.array(got, np.int32)))
        count[k] = len(got)
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]), np.int32)
    for k, depth, i in pieces:
        out[ends[k] - 1 - depth] = i
    begin = np.concatenate([[0], ends])[np.searchsorted(start, at)]
    return out, begin


def decode_bytes(p: Pieces, ids: np.ndarray) -> np.ndarray:
    """The pieces' bytes, one after the other."""
    n = p.length[ids]
    ends = np.cumsum(n)
    return p.blob[np.repeat(p.offset[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode(p: Pieces, ids) -> str:
    """The text that gave these ids."""
    return bytes(decode_bytes(p, np.asarray(ids, np.int64)))[1:].decode()


def _lead(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    full = pc.fill_null(column.cast(pa.large_string()), "")
    of = lambda x: pa.scalar(x, pa.large_string())
    return pc.if_else(pc.equal(full, of("")), of(""), pc.binary_join_element_wise(of(""), full, of(" ")))


def encode(docs: DataFrame, pieces: Pieces, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids (array of int), lossless (decoding gave the text's bytes back)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary

    def run(batches):
        p = shared.value
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                for first, data, at in T.runs(_lead(part.column(1)), 2 << 20):
                    n = len(at) - 1
                    ids, begin = encode_run(p, data, at, keys[first : first + n], seed)
                    back = decode_bytes(p, ids)
                    same = len(back) == len(data) and bool((back == data).all())
                    ok = [same or bytes(decode_bytes(p, ids[begin[i] : begin[i + 1]])) == bytes(data[at[i] : at[i + 1]]) for i in range(n)]
                    gone = null[first : first + n]
                    lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                    if gone.any():
                        lists = lists.take(pa.array([None if g else i for i, g in enumerate(gone)], pa.int64()))
                    yield pa.record_batch([part.column(0).slice(first, n), pa.array(np.diff(begin).astype(np.int32), mask=gone), lists, pa.array(ok, pa.bool_(), mask=gone)], ["doc_id", "n_pieces", "ids", "lossless"])

    from pyspark.sql import functions as F

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_pieces int, ids array<int>, lossless boolean")
