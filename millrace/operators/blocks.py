"""Vectors in blocks that meet by equi-join: exact joins by angle without comparing what can't be near.

Vectors are scaled to length 1 and dealt into cells by their nearest pivot (spherical k-means on a bounded sample). Angles obey the
triangle inequality, so what is known of two cells alone bounds how near their vectors can be: the angle between their pivots less both
radii, and for each of REFS reference pivots the gap between the two cells' ranges of angles to it. Pairs of cells whose bound lies
beyond the question never meet. Cells are cut into pages of about PAGE rows, and a pair of pages is one matrix product. Pages of cells
near each other make a tile, a pair of tiles is one group of two tables: a row is copied once for each tile that holds something it must
meet, not once for each page. Tiles are a sixteenth of all rows, or `tile` entries if that is less. A vector that many rows share is a
cell of many pages, never one task.

Vectors null, empty, or with a null or non-finite component take no part; a zero vector stays zero, its cosine with any is 0; shorter
vectors count as if they had zeros at their end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.shared import cut

CELLS, REFS, PAGE, TILE, HELD = 1024, 32, 2048, 1 << 20, 1 << 20
SAMPLE, SAMPLE_CELLS = 1 << 14, 1 << 22  # rows, and entries, of the sample that pivots come from
_SLACK = 1e-7  # rounding never prunes


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
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


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1)[:, None]


def usable(vector: str) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _pivots(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, label, x)
        n = np.sqrt((s * s).sum(1))
        c = np.where(n[:, None] > 0, s / np.where(n > 0, n, 1)[:, None], c)
    return c


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


def _chain(c: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest one that is left."""
    out, left = [0], np.ones(len(c), bool)
    left[0] = False
    while len(out) < len(c):
        out.append(int(np.where(left, c @ c[out[-1]], -np.inf).argmax()))
        left[out[-1]] = False
    return out


def _units(t: pa.Table) -> list[tuple[int, pa.Table]]:
    """A tile's pages in a fixed order, each with its cell."""
    t = t.combine_chunks()
    cell, page = t["cell"].to_numpy(), t["page"].to_numpy()
    order = np.lexsort((page, cell))
    t, cell, page = t.take(pa.array(order)).combine_chunks(), cell[order], page[order]
    at = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (page[1:] != page[:-1]))) if len(cell) else []
    return [(int(cell[i]), t.slice(i, j - i)) for i, j in zip(at, [*at[1:], len(cell)], strict=True)] if len(cell) else []


class Blocks:
    """rows(id, v, cell, page, tile, and the columns asked to be kept) in the shared folder, and what the driver knows of the cells."""

    def __init__(self, rows: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), cells: int | None = None, page: int = PAGE, tile: int = TILE):
        spark = rows.sparkSession
        self.spark, self.keep, self.page, self.tile = spark, keep, page, tile
        flat = rows.where(usable(vector)).select(F.col(key).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"), *keep)
        self.total, self.dims = flat.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        most = max(1, min(SAMPLE, SAMPLE_CELLS // self.dims))
        n = max(1, min(cells or self.total // 1024, CELLS, most))
        sample = flat.select("v").orderBy(F.xxhash64("id")).limit(most).toArrow()["v"] if n > 1 else None
        self.pivots = _pivots(_unit(matrix(sample, self.dims)), n) if n > 1 and len(sample) else np.zeros((1, self.dims))
        pivots, dims = spark.sparkContext.broadcast(self.pivots), self.dims
        names = flat.columns

        def assign(batches):
            for b in batches:
                x = _unit(matrix(b.column(1), dims))
                yield pa.record_batch([b.column(0), lists(x), *b.columns[2:], pa.array((x @ pivots.value.T).argmax(1), pa.int32())], [*names, "cell"])

        types = dict(flat.dtypes)
        ddl = ", ".join(f"`{c}` {'array<double>' if c == 'v' else types[c]}" for c in names)
        dealt = cut(flat.mapInArrow(assign, ddl + ", cell int"))
        refs = min(REFS, len(self.pivots))

        def ranges(batches):
            low, high = np.full((len(pivots.value), refs + 1), np.inf), np.full((len(pivots.value), refs + 1), -np.inf)
            count = np.zeros(len(pivots.value), np.int64)
            for b in batches:
                x, cell = matrix(b.column(0), dims), b.column(1).to_numpy()
                a = np.concatenate([_angles(x, pivots.value[:refs]), np.arccos(np.clip((x * pivots.value[cell]).sum(1), -1, 1))[:, None]], 1)
                a[~x.any(1)] = np.pi / 2  # a zero vector's cosine is 0
                np.minimum.at(low, cell, a)
                np.maximum.at(high, cell, a)
                count += np.bincount(cell, minlength=len(count))
            full = np.flatnonzero(count)
            at = np.repeat(full, refs + 1)
            if len(full):
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.tile(np.arange(refs + 1), len(full)), pa.int32()), pa.array(low[full].ravel()), pa.array(high[full].ravel()), pa.array(count[at])], ["cell", "ref", "low", "high", "n"])

        self.low, self.high = np.full((n, refs + 1), np.inf), np.full((n, refs + 1), -np.inf)
        self.count = np.zeros(n, np.int64)
        for r in dealt.select("v", "cell").mapInArrow(ranges, "cell int, ref int, low double, high double, n long").groupBy("cell", "ref").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # at most CELLS * (REFS + 1) rows
            self.low[r.cell, r.ref], self.high[r.cell, r.ref], self.count[r.cell] = r.low, r.high, r.n
        self.pages = -(-self.count // page)
        wide = max(page, min(tile // max(1, self.dims), self.total // 16))
        units, self.tiles, held = [], [set()], 0.0
        for c in _chain(self.pivots):
            for p in range(int(self.pages[c])):
                share = self.count[c] / self.pages[c]
                if held and held + share > wide:
                    self.tiles.append(set())
                    held = 0.0
                held += share
                self.tiles[-1].add(c)
                units.append((c, int(self.pages[c]), p, len(self.tiles) - 1))
        of = F.broadcast(spark.createDataFrame([u[::2] + u[3:] for u in units], "cell int, page int, tile int"))  # a row a page
        sizes = F.broadcast(spark.createDataFrame(sorted({u[:2] for u in units}), "cell int, pages int"))  # at most CELLS rows
        self.rows = dealt.join(sizes, "cell").withColumn("page", F.pmod(F.xxhash64("id"), "pages").cast("int")).join(of, ["cell", "page"]).select(*names, "cell", "page", "tile")

    def bounds(self) -> np.ndarray:
        """For each pair of cells the smallest angle that two of their vectors can have, as far as is known."""
        gap = np.zeros((len(self.count), len(self.count)))
        for r in range(self.low.shape[1] - 1):
            gap = np.maximum(gap, np.maximum(self.low[:, None, r] - self.high[None, :, r], self.low[None, :, r] - self.high[:, None, r]))
        if len(self.count) > 1:
            own = self.high[:, -1]
            gap = np.maximum(gap, _angles(self.pivots, self.pivots) - own[:, None] - own[None, :])
        return np.where(np.isfinite(gap), gap, 0) - _SLACK

    def pairs(self, reach: np.ndarray | float) -> list[tuple[int, int]]:
        """Pairs i <= j of cells with rows whose vectors can be within `reach` of each other (one angle, or one for each cell or pair)."""
        r = np.asarray(reach, float)
        if r.ndim < 2:
            r = np.broadcast_to(r, self.count.shape)
            r = np.maximum(r[:, None], r[None, :])
        full = self.count > 0
        near = (self.bounds() <= r) & full[:, None] & full[None, :]
        i, j = np.nonzero(np.triu(near))
        weight = lambda a, b: float((self.count[a] * self.count[b]).sum())
        a, b = np.nonzero(np.triu(full[:, None] & full[None, :]))
        self.pruned = 1 - weight(i, j) / weight(a, b) if len(a) else 0.0
        return list(zip(i.tolist(), j.tolist(), strict=True))

    def meet(self, pairs: list[tuple[int, int]], task: Callable, ddl: str, rows: DataFrame | None = None, thin: Callable | None = None, ready: Callable = lambda t: t) -> DataFrame:
        """task(x, y, same) -> Arrow table for every two pages of the pairs; `same` says that both are one page, met once. `ready` turns a
        page's table into what the task takes, once. What the pages of two tiles give goes through `thin`
        together, whenever it has grown by HELD rows."""
        rows = self.rows if rows is None else rows
        near = np.zeros((len(self.count),) * 2, bool)
        for i, j in pairs:
            near[i, j] = near[j, i] = True
        holds = np.zeros((len(self.tiles), len(self.count)), np.float32)
        for t, cells in enumerate(self.tiles):
            holds[t, sorted(cells)] = 1
        met = np.argwhere(np.triu(holds @ near @ holds.T > 0)).tolist()
        self.copies = float(sum(1 + (s < t) for s, t in met)) / len(self.tiles)
        shape = self.spark.createDataFrame([tuple(m) for m in met], "s int, t int")  # pairs of tiles
        left = rows.join(F.broadcast(shape), F.col("tile") == F.col("s"))
        right = rows.toDF(*rows.columns).join(F.broadcast(shape.where("s < t").toDF("s", "t")), F.col("tile") == F.col("t"))
        left, right = (x.toDF(*x.columns) for x in (left, right))  # own names for either side of the self-join
        known, schema = self.spark.sparkContext.broadcast(near), to_arrow_schema(StructType.fromDDL(ddl))

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows:
                return schema.empty_table()
            own = x["s"][0].as_py() == x["t"][0].as_py()
            mine = [(c, ready(u)) for c, u in _units(x)]
            other = mine if own else [(c, ready(u)) for c, u in _units(y)]
            out, held, most = [schema.empty_table()], 0, HELD
            for i, (c, u) in enumerate(mine):
                for j, (d, v) in enumerate(other):
                    if known.value[c, d] and (not own or i <= j):
                        out.append(task(u, v, own and i == j).cast(schema))
                        held += out[-1].num_rows
                        if thin is not None and held > most:
                            out = [thin(pa.concat_tables(out))]
                            held = out[0].num_rows
                            most = max(HELD, 2 * held)
            return pa.concat_tables(out) if thin is None else thin(pa.concat_tables(out))

        return left.groupBy("s", "t").cogroup(right.groupBy("s", "t")).applyInArrow(run, ddl)


def similar_pairs(rows: DataFrame, key: str, vector: str, threshold: float, cells: int | None = None, page: int = PAGE) -> DataFrame:
    """(a, b, sim): all pairs with cosine >= threshold, a < b, exact. The frame's `pruned` is the share of pairs that never met."""
    blocks = Blocks(rows, key, vector, cells=cells, page=page)
    dims = blocks.dims
    kind = dict(blocks.rows.dtypes)["id"]
    pairs = blocks.pairs(np.pi if threshold <= 0 else float(np.arccos(min(1.0, threshold))))

    def task(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        u, v = matrix(x["v"], dims), matrix(y["v"], dims)
        s = u @ v.T
        near = s >= threshold - 1e-12
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        return pa.table([x["id"].take(pa.array(i)), y["id"].take(pa.array(j)), pa.array((u[i] * v[j]).sum(1))], ["a", "b", "sim"])

    out = blocks.meet(pairs, task, f"a {kind}, b {kind}, sim double").where(F.col("sim") >= threshold)
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").where("a < b")
    out.pruned, out.copies = blocks.pruned, blocks.copies
    return out
