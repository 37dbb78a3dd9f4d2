"""Shared helpers: the cluster's shared folder, lineage cuts, connected components and the linking of groups."""

from __future__ import annotations

import atexit
import contextvars
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_cuts: dict[str, SparkSession] = {}
_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


class Scope:
    """The cuts made inside a `with` block: `end` deletes them, and no others."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._was = _scope.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scope.reset(self._was)

    def end(self, *keep: DataFrame) -> None:
        kept = {df.cut_path for df in keep}
        for path in self.paths:
            if path not in kept:
                _delete(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. One is made only where the session names none and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, *done: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back, so that later plans restart from the files, not from lineage.

    `done` are earlier cuts that nothing but df reads; their files go. What is left goes with its `Scope` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    _cuts[path] = spark
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    df.write.option("compression", codec).parquet(path)
    drop(*done)
    gc.collect()
    spark._jvm.System.gc()  # lets go of shuffle files that no plan needs any more
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*done: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in done:
        _delete(df.cut_path)


def _delete(path: str) -> None:
    spark = _cuts.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _end() -> None:
    for path in list(_cuts):
        _delete(path)


def wrapped(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that no column of theirs can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unwrapped(df: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns of `row` again, those named in `replaced` by other expressions."""
    return df.select(*(replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FOREST_IDS = 1_000_000


def _forest(batches):
    """Edges -> edges to the least id of each tree of this partition, at most one per id; memory is bounded by FOREST_IDS."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def out():
        ids = [x for x in parent if find(x) != x]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([parent[x] for x in ids], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_IDS:
            yield out()
            parent.clear()
    if parent:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (id, component), the smallest id reachable, for every id on an edge with another.

    Each partition replaces its edges by a forest, before and after each shuffle that drops repeated ones, so that few edges are one
    forest at once. Large-star and small-star steps alternate until no edge changes; both move only minima (partially aggregated before
    the shuffle), never neighbour lists, so a hub of any degree costs rows, not memory. Self loops and repeated edges are allowed.
    """
    forest = lambda df: df.mapInArrow(_forest, "u long, v long")
    e = cut(forest(forest(edges.select("a", "b").where("a <> b")).distinct()))
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
    was = mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = forest(large)  # fewer rows for the second step, no other components
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        e = cut(forest(small), e)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    out = e.toDF("id", "component").union(roots)
    out.cut_path = e.cut_path
    return out


def distinct_groups(members: DataFrame) -> DataFrame:
    """members(g, id, ...) of one g for each different set of ids, of groups with two ids or more. Sets are told apart by 128 bits."""
    h = F.xxhash64("id")
    marks = members.groupBy("g").agg(F.count("*").alias("c"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("c > 1")
    return members.join(marks.groupBy("c", "x", "y").agg(F.min("g").alias("g")).select("g"), "g", "left_semi")


class Links:
    """Components that grow by links."""

    def __init__(self):
        self.comp: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        links, was = cut(links.select("a", "b")), self.comp
        if was is None:
            found = connected_components(links)
            self.comp = cut(found, found, links)
        elif links.isEmpty():
            drop(links)
        else:  # new links join components by their least ids; the work grows with the links, not with all that is joined already
            ends = links.join(was.toDF("a", "x"), "a", "left").join(was.toDF("b", "y"), "b", "left")
            found = connected_components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            moved = was.join(found.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            self.comp = cut(moved.union(found.join(was, "id", "left_anti")), found, links, was)

    def label(self, members: DataFrame) -> DataFrame:
        """members with comp, an id without links being its own."""
        if self.comp is None:
            return members.withColumn("comp", F.col("id"))
        return members.join(self.comp.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def live(self, members: DataFrame) -> DataFrame:
        """members, labelled, of groups that span several components."""
        m = self.label(members)
        return m.join(m.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("g"), "g", "left_semi")


def link_groups(members: DataFrame, verify, cross, rounds: int = 2, links: Links | None = None) -> DataFrame:
    """Connected components of the links among members of common groups, without listing all pairs of a group.

    members(g, id): candidates (a cut), two ids can be linked only if they share a g. verify(pairs(a, b)) -> the true links among
    them. In each round every group names one member its centre (another one each round), each id outside the centre's component is
    tested against the centre it meets most often, and components are joined along the links found. What then still spans several
    components goes to cross(rows(g, id, comp)) -> links(a, b), which must join every two components that a true link in a group
    joins. Returns (id, component) for ids with a link; nothing is sampled or capped, the rounds only save tests.
    """
    links = links or Links()
    for r in range(rounds):
        m = cut(links.live(members))
        centre = m.groupBy("g").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "comp")).alias("c")).select("g", F.col("c.id").alias("cid"), F.col("c.comp").alias("ccomp"))
        meet = m.join(centre, "g").where("comp <> ccomp").groupBy("id", "cid").agg(F.count("*").alias("n"))
        links.add(verify(meet.groupBy("id").agg(F.max(F.struct("n", "cid")).alias("m")).select(F.col("id").alias("a"), F.col("m.cid").alias("b"))))
        drop(m)
    m = cut(links.live(members))
    links.add(cross(m))
    drop(m)
    return links.comp
