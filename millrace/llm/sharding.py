"""Consistent-hash ring with virtual nodes and bounded loads.

A ring of `cells` fixed cells carries `vnodes` virtual nodes per shard; a row's key hash picks its cell, and the cell's order of
shards is the order in which virtual nodes follow clockwise. Shard capacities differ by at most one row and sum to the row count.
Rows that find their shard full continue clockwise. Rows of one cell are interchangeable, so the cascade is solved on the cell
counts alone (at most `cells` x shards numbers, whatever the input), and each row then only needs its rank within its cell.

Defined results: a null key hashes the text's checksum instead; null text counts as empty (size 1, checksum 0); equal rows get
different slots, in no told order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def ring(n_shards: int, vnodes: int, cells: int) -> list[list[int]]:
    """Each cell's shards in clockwise order. A virtual node that falls on a taken cell moves to the next free one."""
    if n_shards * vnodes > cells:
        raise ValueError("more virtual nodes than cells")
    owner: list[int | None] = [None] * cells
    for v in range(vnodes):
        for s in range(n_shards):
            at = _mix(s * 1_000_003 + v) % cells
            while owner[at] is not None:
                at = (at + 1) % cells
            owner[at] = s
    prefs: list[list[int]] = [[]] * cells
    order: list[int] = []
    for i in range(2 * cells - 1, -1, -1):  # walk back twice so that every cell sees the whole ring ahead of it
        s = owner[i % cells]
        if s is not None:
            order = [s] + [x for x in order if x != s]
        if i < cells:
            prefs[i] = order
    return prefs


def cascade(counts: dict[int, int], prefs: list[list[int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, shard, lo, hi, base): rows ranked lo+1..hi of the cell go to the shard, at slots base + rank - lo - 1."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    left, used, out = dict(counts), [0] * n_shards, []
    for r in range(n_shards):
        for cell in sorted(left):
            s = prefs[cell][r]
            take = min(left[cell], room[s])
            if take:
                lo = counts[cell] - left[cell]
                out.append((cell, s, lo, lo + take, used[s]))
                left[cell] -= take
                room[s] -= take
                used[s] += take
    return out


def assign(docs: DataFrame, n_shards: int = 8, vnodes: int = 64, cells: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, home_shard (first choice), shard, slot for every row of docs(doc_id, text)."""
    prefs = ring(n_shards, vnodes, cells)
    text = F.coalesce("text", F.lit(""))
    bits = cells.bit_length() - 1
    if 1 << bits != cells:
        raise ValueError("cells must be a power of two")
    crc = F.crc32(text)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), crc)).alias("h"),
    ).withColumn("cell", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
    spark = docs.sparkSession
    plan = spark.createDataFrame(cascade(counts, prefs, n_shards), "cell int, shard int, lo long, hi long, base long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")).cast("long")
    home = F.element_at(F.array([F.lit(p[0]) for p in prefs]), F.col("cell") + 1)
    ranked = keyed.withColumn("rank", rank)
    placed = ranked.join(F.broadcast(plan), "cell").where("rank > lo and rank <= hi")  # plan: bounded by cells x shards
    return placed.select("doc_id", "size", "text_crc32", home.alias("home_shard"), "shard", (F.col("base") + F.col("rank") - F.col("lo") - 1).alias("slot"))
