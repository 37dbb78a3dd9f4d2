"""Exact Shapley attribution of tree models along their paths, from a table of nodes.

nodes(tree, weight, id, feature, threshold, left, right, value, cover): an inner node sends x[feature] <= threshold to `left`, all else
(NaN too) to `right`; a leaf has left < 0 and a value. The value of a set of known features is the tree's expectation in which unknown
ones follow both branches by cover. Such an expectation is a sum over leaves of value * prod(known: 1 if x takes the path's branches
on the feature, else 0) * prod(unknown: share of cover that takes them), so a leaf's part in a feature's Shapley value depends on no
more than which of the path's features x agrees with. Those parts are tabled per leaf and looked up for whole Arrow batches.

The node table of a model is that of its trees: it travels to every task, and MAX_LEAVES bounds it.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, weight double, id int, feature int, threshold double, left int, right int, value double, cover double"
MAX_LEAVES = 1_000_000
_TABLE = 10  # path features up to which all patterns are tabled


def model_nodes(spark: SparkSession, path: str) -> DataFrame:
    """NODES of a stored tree model. Boosted trees give log-odds, forests and single trees the probability of class 1."""
    data = spark.read.parquet(f"{path}/data")
    kind = spark.read.text(f"{path}/metadata").first()[0]
    n = F.col("nodeData")
    if data.select(F.max(n.split.numCategories)).first()[0] > 0:
        raise ValueError("categorical splits have no attribution here")
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        trees = spark.createDataFrame([(0, 1.0)], "treeID int, w double")
    else:
        trees = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("w"))
    boosted = "GBTClassification" in kind
    stats = n.impurityStats
    value = n.prediction if boosted else F.try_divide(F.try_element_at(stats, F.lit(2)), F.aggregate(stats, F.lit(0.0), lambda s, x: s + x))
    weight = 2 * F.col("w") if boosted else F.lit(1.0 / trees.count())  # the probability is the sigmoid of twice the boosted sum
    return data.join(F.broadcast(trees), "treeID").select(  # a row a tree
        F.col("treeID").alias("tree"), weight.alias("weight"), n.id.alias("id"), n.split.featureIndex.alias("feature"),
        F.try_element_at(n.split.leftCategoriesOrThreshold, F.lit(1)).alias("threshold"), n.leftChild.alias("left"), n.rightChild.alias("right"), value.alias("value"), n.rawCount.cast("double").alias("cover"))


def _by_tree(nodes: list) -> dict:
    trees: dict = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.id] = r
    return trees


def measured_cover(rows: DataFrame, features: str, nodes: DataFrame) -> DataFrame:
    """nodes with cover: how many of `rows` reach each. For trees without counts of their own, or another background."""
    found = nodes.limit(4 * MAX_LEAVES).collect()
    trees = rows.sparkSession.sparkContext.broadcast(_by_tree(found))

    def run(batches):
        seen: dict = {}
        for b in batches:
            x = np.array(b.column(0).drop_null().to_pylist(), np.float64)
            for tree in trees.value.values():
                stack = [(tree[0], np.arange(len(x)))]
                while stack:
                    node, on = stack.pop()
                    seen[node.tree, node.id] = seen.get((node.tree, node.id), 0) + len(on)
                    if node.left >= 0:
                        goes = x[on, node.feature] <= node.threshold
                        stack += [(tree[node.left], on[goes]), (tree[node.right], on[~goes])]
        if seen:
            yield pa.record_batch([pa.array([t for t, _ in seen], pa.int32()), pa.array([i for _, i in seen], pa.int32()), pa.array([float(n) for n in seen.values()])], ["tree", "id", "n"])

    cover = rows.select(features).mapInArrow(run, "tree int, id int, n double").groupBy("tree", "id").agg(F.sum("n").alias("cover"))
    return nodes.join(cover, ["tree", "id"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))


def shares(agree: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley values of the game prod(known: agree) * prod(unknown: zero), for each row of agree (patterns x features)."""
    m = agree.shape[1]
    w = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.zeros(agree.shape)
    for i in range(m):
        c = np.zeros((len(agree), m))  # by number of known others: the sum over such sets of the others' product
        c[:, 0] = 1
        for j in range(m):
            if j != i:
                c[:, 1:] = c[:, 1:] * zero[j] + c[:, :-1] * agree[:, j : j + 1]
                c[:, 0] *= zero[j]
        out[:, i] = (agree[:, i] - zero[i]) * (c @ w)
    return out


class Paths:
    """A leaf's features, the interval each must lie in, the share of cover that goes its way, and the leaf's weighted value."""

    def __init__(self, nodes: list):
        self.leaves, self.base = [], 0.0
        for tree in _by_tree(nodes).values():
            stack = [(tree[0], {})]
            while stack:
                node, on = stack.pop()
                if node.left < 0:
                    self._leaf(node.weight * node.value, on)
                    continue
                for side, child in ((0, tree[node.left]), (1, tree[node.right])):
                    low, high, zero = on.get(node.feature, (-np.inf, np.inf, 1.0))
                    low, high = (low, min(high, node.threshold)) if side == 0 else (max(low, node.threshold), high)
                    stack.append((child, {**on, node.feature: (low, high, zero * (child.cover / node.cover if node.cover else 0.0))}))
            if len(self.leaves) > MAX_LEAVES:
                raise ValueError(f"over {MAX_LEAVES} leaves")

    def _leaf(self, value: float, on: dict) -> None:
        zero = np.array([z for _, _, z in on.values()])
        self.base += value * float(np.prod(zero))
        m = len(on)
        if m and value:
            table = value * shares((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float), zero) if m <= _TABLE else None
            self.leaves.append((list(on), [(a, b) for a, b, _ in on.values()], zero, value, table))

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row and column of x."""
        out = np.zeros(x.shape)
        for features, bounds, zero, value, table in self.leaves:
            agree = [~(x[:, f] <= a) & ((x[:, f] <= b) if b < np.inf else True) for f, (a, b) in zip(features, bounds, strict=True)]
            if table is not None:
                key = np.zeros(len(x), np.int64)
                for j, a in enumerate(agree):
                    key |= a.astype(np.int64) << j
                out[:, features] += table[key]
            else:
                kinds, which = np.unique(np.stack(agree, 1), axis=0, return_inverse=True)
                out[:, features] += value * shares(kinds.astype(float), zero)[which.ravel()]
        return out


def attribute(rows: DataFrame, features: str, nodes: DataFrame, names: list[str]) -> DataFrame:
    """rows with `contributions` (array of double, one for each distinct name in order) and `base`; base + contributions add up to the
    model's margin. features: a column of array<double>; names[i] is what column i counts for, columns of one name are added up.
    No shuffle: the rows pass through in Arrow batches. A row without features gets nulls."""
    spark = rows.sparkSession
    paths = spark.sparkContext.broadcast(Paths(nodes.limit(4 * MAX_LEAVES).collect()))
    order = list(dict.fromkeys(names))
    fold = np.zeros((len(names), len(order)))
    fold[np.arange(len(names)), [order.index(n) for n in names]] = 1
    at = rows.columns.index(features)

    def run(batches):
        for b in batches:
            known = np.array(b.column(at).is_valid())
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            size = np.where(known, len(order), 0)
            offsets = pa.array([*map(int, np.concatenate([[0], np.cumsum(size)]))], pa.int32(), mask=np.append(~known, False))
            got = pa.ListArray.from_arrays(offsets, pa.array((paths.value.values(x) @ fold).ravel()))
            yield pa.record_batch([*b.columns, got, pa.array(np.full(b.num_rows, paths.value.base), mask=~known)], [*b.schema.names, "contributions", "base"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, contributions array<double>, base double")


def drivers(contributions: Column, names: list[str], k: int = 5) -> Column:
    """The k (feature, contribution) of largest absolute contribution, equal ones by name; inside the row, without a shuffle."""
    order = list(dict.fromkeys(names))
    pairs = F.zip_with(F.array(*map(F.lit, order)), contributions, lambda n, c: F.struct((-F.abs(c)).alias("o"), n.alias("feature"), c.alias("contribution")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.when(contributions.isNotNull(), F.transform(top, lambda p: F.struct(p.feature.alias("feature"), p.contribution.alias("contribution"))))


def mean_absolute(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, importance: mean absolute contribution, one aggregate over the arrays."""
    order = list(dict.fromkeys(names))
    one = rows.agg(*(F.avg(F.abs(F.col("contributions")[i])).alias(str(i)) for i in range(len(order))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"`{i}`").alias("importance")) for i, n in enumerate(order)))).alias("x")).select("x.*")
