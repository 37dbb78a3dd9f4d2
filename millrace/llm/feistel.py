"""Training-order materialisation: every sequence gets a global slot from a keyed permutation, and slots lie in fixed-stride shards.

Texts become token ids (their UTF-8 bytes, or a byte-level BPE), each text closed by an end token, and are packed without padding into
sequences of `seq_len` ids in order of doc_id; only the last sequence is padded. Packing needs each row's offset in the token
stream: counts are summed per key bucket, the buckets' sums are added up, and ranks are taken within a bucket only.
A Feistel network over the smallest even-bit domain that holds all sequences, walked until it lands inside, permutes sequence
numbers into slots with no table: any worker can compute any slot, and resuming needs the next slot alone.
Slots are range-partitioned; `write_order` writes each shard as one file of at most `per_shard` records of equal bytes and nothing else,
so record i of a shard starts at i * stride. A file gets its name when it is whole; a later call with the same arguments writes
the missing shards only. `read_record` seeks one slot.

Defined results: null text counts as empty (its end token only); null doc_ids come first; rows that repeat a doc_id are
ordered by their text's hash, and equal rows are interchangeable; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_M = np.uint64


def _round(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _M(key)) * _M(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
        return x ^ (x >> _M(29))


def round_keys(key: str, rounds: int = 6) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "little") for i in range(rounds)]


def permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """Keyed bijection of 0..n-1."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, keys = _M((1 << half) - 1), round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> _M(half), x & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        return (left << _M(half)) | right

    x = once(np.asarray(index, np.uint64))
    out = x >= _M(n)
    while out.any():  # cycle-walking: the domain is under four times n, so few steps are needed
        x[out] = once(x[out])
        out = x >= _M(n)
    return x.astype(np.int64)


class Tokens:
    """Token ids of texts. 'bytes': id = byte, end 256. A path of ranks: byte-level BPE, end = number of ranks."""

    def __init__(self, encoding: str = "bytes", pattern: str | None = None):
        self.encoding, self.pattern, self._bpe = encoding, pattern, None
        self.end = 256 if encoding == "bytes" else sum(1 for line in open(encoding, "rb") if line.strip())
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.encoding == "bytes":
            ids = np.frombuffer(text.encode(), np.uint8).astype(self.dtype)
        else:
            if self._bpe is None:
                import tiktoken

                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(self.encoding, "rb"))}
                self._bpe = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            ids = np.array(self._bpe.encode_ordinary(text), self.dtype)
        return ids


def offsets(groups: DataFrame, bucket_rows: int = 1 << 16) -> tuple[DataFrame, int]:
    """groups(k, missing, tie, n) -> k, missing, tie, start (sum of n over all groups before, nulls first, then by k and tie); total.

    Buckets are ranges of k; only their sums (one row for about bucket_rows ids) meet in one place, as a cumulative sum.
    """
    spark = groups.sparkSession
    keyed = groups.withColumn("bucket", F.when(F.col("missing"), F.lit(-(1 << 62))).otherwise(F.floor(F.col("k") / bucket_rows)))
    sums = keyed.groupBy("bucket").agg(F.sum("n").alias("s")).orderBy("bucket").toPandas()
    base = [(int(b), int(x)) for b, x in zip(sums.bucket, sums.s.cumsum() - sums.s, strict=True)]
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("k", "tie").rowsBetween(Window.unboundedPreceding, -1))
    out = keyed.join(spark.createDataFrame(base, "bucket long, base long"), "bucket").select("k", "missing", "tie", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"))
    return out, int(sums.s.sum())


_OUT = "slot long, shard long, byte_offset long, seq long, n_tokens int, tokens binary"


def materialise(docs: DataFrame, key: str, seq_len: int = 2048, per_shard: int = 4096, tokens: Tokens | None = None, skip: Callable[[int], list[int]] | None = None) -> DataFrame:
    """slot, shard, byte_offset, seq (number before the permutation), n_tokens, tokens (fixed-stride bytes); partitions are ranges of slots, sorted.

    skip(number of sequences) names shards to leave out; their texts are cut but neither shuffled nor assembled.
    """
    spark = docs.sparkSession
    tokens = tokens or Tokens()
    plain = tokens.encoding == "bytes"
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce(doc, F.lit(0)).alias("k"), doc.isNull().alias("missing"), F.xxhash64(text).alias("tie"), text.alias("text"))
    if plain:
        counts = base.withColumn("n", F.octet_length("text").cast("long") + 1)
    else:
        counts = base.withColumn("n", F.pandas_udf(lambda t: t.map(lambda x: len(tokens(x)) + 1), "long")("text"))
    starts, total = offsets(counts.groupBy("k", "missing", "tie").agg(F.sum("n").alias("n")))
    n_seq = -(-total // seq_len)
    if not n_seq:
        return spark.createDataFrame([], _OUT)
    stride = seq_len * tokens.dtype.itemsize
    without = np.array(skip(n_seq) if skip else [], np.int64)
    # Equal rows of one doc_id share a start; each takes its own place after it.
    nth = F.row_number().over(Window.partitionBy("k", "missing", "tie").orderBy(F.lit(0))) - 1
    placed = base.join(starts, ["k", "missing", "tie"]).select("start", nth.alias("nth"), "text")
    ids_of = (lambda t: np.frombuffer(t.encode(), np.uint8)) if plain else tokens
    narrow = np.dtype(np.uint8) if plain else tokens.dtype

    def pieces(batches):
        """Cuts each row's ids at sequence ends. The end token is not sent: records are filled with it beforehand."""
        for b in batches:
            seq, at, part, size = [], [], [], 0

            def out(seq, at, part):
                s = np.array(seq, np.int64)
                slot = permute(s, n_seq, key)
                got = pa.record_batch([pa.array(slot, pa.int64()), pa.array(s), pa.array(at, pa.int32()), pa.array(part, pa.binary())], ["slot", "seq", "at", "part"])
                return got.filter(pa.array(~np.isin(slot // per_shard, without))) if len(without) else got

            for start, again, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, i = ids_of(t), 0
                start += again * (len(ids) + 1)
                while i <= len(ids):
                    s, o = divmod(start + i, seq_len)
                    j = min(len(ids) + 1, i + seq_len - o)
                    seq.append(s)
                    at.append(o)
                    part.append(ids[i:j].tobytes())
                    size += len(part[-1])
                    i = j
                if size > 8 << 20:
                    yield out(seq, at, part)
                    seq, at, part, size = [], [], [], 0
            if seq:
                yield out(seq, at, part)

    def assemble(batches):
        done: list[tuple] = []
        cur = None

        def flush():
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        def record():
            slot, s, buf = cur
            return slot, slot // per_shard, slot % per_shard * stride, s, min(seq_len, total - s * seq_len), buf.tobytes()

        schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])
        for b in batches:
            for slot, s, o, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cur is None or slot != cur[0]:
                    if cur is not None:
                        done.append(record())
                    cur = (slot, s, np.full(seq_len, tokens.end, tokens.dtype))
                ids = np.frombuffer(part, narrow)
                cur[2][o : o + len(ids)] = ids
                if len(done) >= 1024:
                    yield flush()
                    done.clear()
        if cur is not None:
            done.append(record())
            yield flush()

    cutd = placed.mapInArrow(pieces, "slot long, seq long, at int, part binary")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_seq)
    dealt = cutd.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(n_seq)).cast("int"))  # slots are dense: equal ranges, no sampling
    return dealt.sortWithinPartitions("slot", "at").mapInArrow(assemble, _OUT)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _put(store: fs.FileSystem, folder: str, name: str, chunks) -> None:
    """Writes a file that has its name only once it is whole."""
    half = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(half) as f:
            for c in chunks:
                f.write(c)
        store.move(half, f"{folder}/{name}")
    except BaseException:
        if store.get_file_info(half).type != fs.FileType.NotFound:
            store.delete_file(half)
        raise


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Writes each shard of records to path (a folder that all executors share) as one file of equal-stride records in order of slot.

    Returns (shard, first_slot, n) of what it wrote. A file of a shard that is there already is replaced whole.
    """
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)

    def write(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            shard, first, n = ahead[0], ahead[1], 0

            def chunks():
                nonlocal ahead, n
                while ahead is not None and ahead[0] == shard:
                    if ahead[2] != n * len(ahead[3]):
                        raise ValueError(f"shard {shard} lacks the record before slot {ahead[1]}")
                    yield ahead[3]
                    n, ahead = n + 1, next(rows, None)

            to, at = _store(path)
            _put(to, at, _name(shard), chunks())
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64())], ["shard", "first_slot", "n"])

    schema = "shard long, first_slot long, n long"
    done = records.select("shard", "slot", "byte_offset", "tokens").repartition("shard").sortWithinPartitions("slot").mapInArrow(write, schema)
    rows = [tuple(r) for r in done.collect()]  # one row per file
    return records.sparkSession.createDataFrame(rows, schema)


def write_order(docs: DataFrame, path: str, key: str, seq_len: int = 2048, per_shard: int = 4096, tokens: Tokens | None = None) -> DataFrame:
    """Materialises the order of docs as shard files under path; shards that are there whole are left as they are.

    Returns (shard, first_slot, n) of the shards written now. A folder begun with other arguments or another number of sequences is refused.
    """
    tokens = tokens or Tokens()
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    stride = seq_len * tokens.dtype.itemsize

    def whole(n_seq: int) -> list[int]:
        layout = {"key": key, "seq_len": seq_len, "per_shard": per_shard, "dtype": tokens.dtype.str, "end": tokens.end, "n_seq": n_seq}
        if store.get_file_info(f"{folder}/layout.json").type == fs.FileType.NotFound:
            _put(store, folder, "layout.json", [json.dumps(layout).encode()])
        elif _layout(store, folder) != layout:
            raise ValueError(f"{path} holds another order")
        have = {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(folder))}
        return [s for s in range(-(-n_seq // per_shard)) if have.get(_name(s)) == min(per_shard, n_seq - s * per_shard) * stride]

    return write_shards(materialise(docs, key, seq_len, per_shard, tokens, whole), path)


def _layout(store: fs.FileSystem, folder: str) -> dict:
    with store.open_input_stream(f"{folder}/layout.json") as f:
        return json.loads(f.read())


def read_record(path: str, slot: int) -> np.ndarray:
    """Token ids of one slot: one seek in one shard file."""
    store, folder = _store(path)
    at = _layout(store, folder)
    if not 0 <= slot < at["n_seq"]:
        raise IndexError(slot)
    dtype = np.dtype(at["dtype"])
    stride = at["seq_len"] * dtype.itemsize
    with store.open_input_file(f"{folder}/{_name(slot // at['per_shard'])}") as f:
        f.seek(slot % at["per_shard"] * stride)
        return np.frombuffer(f.read(stride), dtype)
