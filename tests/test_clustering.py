"""Pruned cosine joins, spanning forests and density clusters against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import graph
from millrace.operators import blocks, cluster, density


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra), "id long, e array<double>").repartition(5)


def clouds(n, dims, k, noise, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(k, dims))
    return c[r.integers(0, k, n)] + noise * r.normal(size=(n, dims))


ODD = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [1.0, 2.0]), (5005, [1.0, None])]


def test_pairs_are_exact_and_pruned(spark):
    x = clouds(900, 8, 30, 0.05, 1)
    rows = table(spark, x, ODD)
    got = blocks.similar_pairs(rows, "id", "e", 0.97, cells=24, page=50)
    u = np.concatenate([x, [[1.0, 2.0, 0, 0, 0, 0, 0, 0]]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    i, j = np.nonzero(np.triu(s >= 0.97, 1))
    name = lambda k: k if k < 900 else 5004
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((int(a), name(int(b))) for a, b in zip(i, j, strict=True)) and len(i) > 1000
    assert got.pruned > 0.5
    assert blocks.similar_pairs(rows.limit(0), "id", "e", 0.9).count() == 0


def test_pairs_meet_at_any_angle(spark):
    x = clouds(60, 4, 60, 1.0, 2)
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    for threshold in (-0.5, 0.0, 0.4):
        got = blocks.similar_pairs(table(spark, x), "id", "e", threshold, cells=5, page=7)
        assert got.count() == int(np.triu(s >= threshold, 1).sum())


def test_components_and_forest(spark):
    r = np.random.default_rng(4)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 80, 400), r.integers(0, 80, 400), r.integers(1, 40, 400), strict=True) if a % 4 == b % 4]
    got = graph.spanning_forest(spark.createDataFrame(e, "a long, b long, w double").repartition(6)).collect()
    sets, best = graph.Union(), []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in e):
        if sets.join(a, b):
            best.append((a, b, w))
    assert sorted(tuple(g) for g in got) == sorted(best)
    star = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(50)] + [(7, 7)]
    of = dict(graph.connected_components(spark.createDataFrame(star, "a long, b long").repartition(6)).collect())
    assert {of[i] for i in range(200)} == {0} and {of[300 + i] for i in range(51)} == {300} and len(of) == 251


def brute_density(x, least, k):
    """Top-down: every length splits a set into the parts that shorter ways hold together."""
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    far = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    core = np.sort(far, 1)[:, k - 1] if k > 1 else np.zeros(n)
    d = np.maximum(np.maximum(np.maximum(d, core[:, None]), core[None, :]), density.NEAR)

    def parts(s, w):
        left, out = set(s), []
        while left:
            stack, seen = [left.pop()], []
            while stack:
                i = stack.pop()
                seen.append(i)
                near = [j for j in left if d[i, j] < w]
                left -= set(near)
                stack += near
            out.append(sorted(seen))
        return out

    def longest(s):
        """The length at which s holds together: the longest edge of its tree."""
        best = {j: d[s[0], j] for j in s[1:]}
        most = 0.0
        while best:
            j = min(best, key=best.get)
            most = max(most, best.pop(j))
            for q in best:
                best[q] = min(best[q], d[j, q])
        return most

    def cluster_of(s, birth, root):
        stay, at = 0.0, s
        while True:
            if len(at) == 1:
                w, split = density.NEAR, [at]
                stay += 1 / w - birth  # never reached: a cluster has `least` points and its parts leave above
                return [(stay, s)]
            w = longest(at)
            split = parts(at, w)
            large = [p for p in split if len(p) >= least]
            if len(large) == 1:
                stay += (len(at) - len(large[0])) * (1 / w - birth)
                at = large[0]
                continue
            stay += len(at) * (1 / w - birth)
            below = [c for p in large for c in cluster_of(p, 1 / w, False)] if large else []
            if root or (below and stay < sum(q for q, _ in below)):
                return below
            return [(stay, s)]

    label = list(range(n))
    for _, s in cluster_of(list(range(n)), 0.0, True):
        for i in s:
            label[i] = min(s)
    return label


@pytest.mark.parametrize(("n", "least", "k", "cells", "part"), [(500, 2, 1, 1, 100_000), (300, 5, 4, 9, 90)])
def test_density_clusters(spark, n, least, k, cells, part):
    x = np.concatenate([clouds(n - 60, 6, 9, 0.08, n), clouds(60, 6, 60, 1.0, n + 1)])
    rows = table(spark, x, [(9000, None), (9001, [0.0] * 6)])
    got = dict(density.clusters(rows, "id", "e", least, k, page=32, cells=cells, part=part).collect())
    want = brute_density(x, least, k)
    assert got.pop(9000) == 9000 and got.pop(9001) == 9001
    assert [got[i] for i in range(n)] == want and 1 < len(set(want)) < n


def test_density_of_copies_and_few_rows(spark):
    base = clouds(12, 4, 3, 0.1, 3)
    rows = table(spark, np.concatenate([base, np.repeat(base[:1], 30, 0)]))
    got = dict(density.clusters(rows, "id", "e").collect())
    assert {got[i] for i in (0, *range(12, 42))} == {0} and len(got) == 42
    one = spark.createDataFrame([(3, [1.0, 0.0])], "id long, e array<double>")
    assert density.clusters(one, "id", "e").collect() == [(3, 3)] and density.clusters(one.limit(0), "id", "e").count() == 0


def test_many_edges_of_one_length(spark):
    """A level that one length fills is joined by grouped sums, as one task would join it."""
    points = spark.createDataFrame([(i, 1) for i in range(60)], "id long, copies long")
    edges = [(i, i + 1, 1.0 if (i % 10) != 9 else 2.0) for i in range(59)]
    e = spark.createDataFrame(edges, "a long, b long, w double")
    for least in (2, 11):
        a, b = (density.condense(points, e, least, part) for part in (10, 1000))
        for x, y in zip(a, b, strict=True):
            assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def test_small_tables_use_the_threshold(spark):
    v = [(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    rows = spark.createDataFrame(v, "id long, e array<double>")
    assert sorted(cluster.cluster_rows(rows, "id", "e").collect()) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    parted = rows.withColumn("p", F.when(F.col("id") == 4, "b"))
    assert dict(cluster.clusters(parted, "id", "e", partition_by="p").collect()) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert math.isclose(float(density._angle(2.0)), math.pi)


def test_retrieval_is_cut_before_it_is_shuffled(spark):
    e = spark.range(50).select(F.col("id").alias("signal_id"), (F.col("id") % 2).cast("string").alias("resource_id"), F.array(F.lit(1.0), F.col("id") / 50).alias("embedding"))
    q = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [1.0, 0.0])], "resource_id string, query_vector array<double>")
    out = cluster.retrieve(e, q, e.where("signal_id <> 0").select("signal_id"), k=3)
    assert [r.signal_id for r in out.orderBy("resource_id", "rank").collect()] == [2, 4, 6, 1, 3, 5]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_rows_are_copied_for_tiles_not_for_pages(spark):
    x = clouds(900, 8, 900, 1.0, 6)  # nothing to prune
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    got = blocks.similar_pairs(table(spark, x), "id", "e", 0.5, cells=60, page=5)
    assert got.count() == int(np.triu(s >= 0.5, 1).sum())
    assert got.copies <= 25  # about 200 pages: 200 copies of every row before
    b = blocks.Blocks(table(spark, x), "id", "e", cells=60, page=5)
    rows = b.rows.withColumn("core", F.lit(0.0))
    edges = b.meet(b.pairs(np.pi), lambda x, y, same: pa.table([x["id"], x["id"], pa.array(np.ones(len(x)))], ["a", "b", "w"]), "a long, b long, w double", rows, lambda t: t.slice(0, 1))
    assert edges.count() <= len(b.tiles) * (len(b.tiles) + 1) // 2 and b.pages.sum() > 150
    tree = density.spanning_tree(b, rows).collect()
    d = np.sqrt(np.maximum(2 - 2 * s, 0))
    at, best, total = 0, d[0].copy(), 0.0
    left = np.arange(900) > 0
    while left.any():
        at = int(np.where(left, best, np.inf).argmin())
        total, best = total + best[at], np.minimum(best, d[at])
        left[at] = False
    assert len(tree) == 899 and sum(r.w for r in tree) == pytest.approx(total)


@pytest.mark.parametrize(("n", "noise", "k", "few"), [(500, 0.08, 1, 40), (500, 0.002, 1, 8), (300, 0.08, 4, 40), (300, 1e-5, 1, 40)])
def test_density_over_landmarks(spark, n, noise, k, few):
    x = np.concatenate([clouds(n - 60, 6, 9, noise, n), clouds(60, 6, 60, 1.0, n + 1)])
    got = dict(density.clusters(table(spark, x), "id", "e", 2, k, page=32, cells=9, few=few).collect())
    want = brute_density(x, 2, k)
    assert [got[i] for i in range(n)] == want and 1 < len(set(want)) < n


def test_pages_meet_by_products_not_point_by_point(spark, monkeypatch):
    """Two pages give the edges shorter than the way over landmarks, found without a tree of the pages."""
    x = clouds(440, 6, 6, 0.3, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    marks, core = x[:40], np.zeros(440)
    a, b = density._tree(marks, core[:40])
    order = density.Order(40, a, b, density._lengths(marks[a], marks[b], core[a], core[b]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    level = d[:40, :40].copy()  # longest edge on the shortest such way between two landmarks
    for m in range(40):
        level = np.minimum(level, np.maximum(level[:, [m]], level[[m]]))
    i, j = np.meshgrid(range(40), range(40))
    assert np.allclose(order.longest(order.place[i], order.place[j]), level)
    at = d[:, :40].argmin(1)
    away = d[np.arange(440), at]
    t = pa.table({"id": np.arange(440), "v": blocks.lists(x), "core": core, "place": order.place[at], "away": away})
    monkeypatch.setattr(density, "_tree", None)
    p, q = (density.Page(u, 6, order) for u in (t.slice(0, 200), t.slice(200)))
    way = np.maximum(np.maximum(away[:, None], away[None, :]), level[at][:, at])
    for u, v, same, area in ((p, q, False, np.s_[:200, 200:]), (p, p, True, np.s_[:200, :200])):
        e = density._shorter(u, v, same, order, density._slack(6))
        short = (d < way - 1e-12)[area]
        first, second = np.nonzero(np.triu(short, 1) if same else short)
        found = set(zip(e["a"].to_pylist(), e["b"].to_pylist(), strict=True))
        assert found == set(zip(first.tolist(), (second if same else second + 200).tolist(), strict=True)) and 0 < len(found) < 6000


def test_forest_by_rounds_and_by_one_task(spark):
    r = np.random.default_rng(5)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 90, 600), r.integers(0, 90, 600), r.integers(1, 30, 600), strict=True) if a % 3 == b % 3]
    sets, best = graph.Union(), []
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in e}):
        if sets.join(a, b):
            best.append((a, b, w))
    rows = spark.createDataFrame(e, "a long, b long, w double").repartition(6)
    for alone in (0, 30, graph.HELD):
        assert sorted(map(tuple, graph.spanning_forest(rows, alone=alone).collect())) == sorted(best)
    of = [sorted(map(tuple, graph.connected_components(rows.select("a", "b"), alone=n).collect())) for n in (0, 1000)]
    assert of[0] == of[1] and {c for _, c in of[0]} == {0, 1, 2}
    a, b, w = (np.array(c) for c in zip(*((min(a, b), max(a, b), w) for a, b, w in e), strict=True))
    assert sorted(tuple(r.values()) for r in graph.thinned(pa.table([a, b, w], ["a", "b", "w"])).to_pylist()) == sorted(best)
