"""Attribution by enumeration, curves by ranges, exact means, folds and stored models."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import attribution, metrics, models, store
from millrace.schemas import FEATURES


class Node:
    def __init__(self, **k):
        self.__dict__.update(k)


def forest(seed, trees=4, depth=5, width=4):
    """Random trees over few features, so that a path asks for one feature again and again; covers are counts of a background."""
    r = random.Random(seed)
    background = np.array([[r.uniform(-1, 1) for _ in range(width)] for _ in range(60)])
    nodes = []
    for t in range(trees):
        at = itertools.count()

        def grow(rows, d, t=t, at=at):
            i = next(at)
            if d == 0 or r.random() < 0.15:
                nodes.append(Node(tree=t, weight=0.5 + t, id=i, feature=-1, threshold=None, left=-1, right=-1, value=r.uniform(-1, 1), cover=float(len(rows))))
                return i
            f, at_ = r.randrange(width), r.uniform(-0.8, 0.8)
            goes = rows[:, f] <= at_
            left, right = grow(rows[goes], d - 1), grow(rows[~goes], d - 1)
            nodes.append(Node(tree=t, weight=0.5 + t, id=i, feature=f, threshold=at_, left=left, right=right, value=0.0, cover=float(len(rows))))
            return i

        grow(background, depth)
    return nodes, background


def expectation(tree, i, x, known):
    n = tree[i]
    if n.left < 0:
        return n.weight * n.value
    if n.feature in known:
        return expectation(tree, n.left if x[n.feature] <= n.threshold else n.right, x, known)
    if not n.cover:
        return 0.0
    return sum(expectation(tree, c, x, known) * tree[c].cover / n.cover for c in (n.left, n.right))


def test_shapley_values_equal_enumeration():
    nodes, _ = forest(5)
    trees = attribution._by_tree(nodes)
    paths = attribution.Paths(nodes)
    x = np.random.default_rng(1).uniform(-1, 1, (25, 4))
    x[3, 1] = np.nan
    f = lambda row, s: sum(expectation(t, 0, row, s) for t in trees.values())
    got = paths.values(x)
    for row, values in zip(x, got, strict=True):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (f(row, {*s, i}) - f(row, set(s))) for k in range(4) for s in itertools.combinations(rest, k))
            assert values[i] == pytest.approx(want, abs=1e-12)
        assert paths.base + values.sum() == pytest.approx(f(row, {0, 1, 2, 3}))


def test_long_paths_need_no_table(monkeypatch):
    nodes, _ = forest(8, depth=7, width=6)
    x = np.random.default_rng(2).uniform(-1, 1, (40, 6))
    want = attribution.Paths(nodes).values(x)
    monkeypatch.setattr(attribution, "_TABLE", 1)
    assert np.allclose(attribution.Paths(nodes).values(x), want)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        v = [r.uniform(-1, 1) if r.random() > 0.1 else None for _ in FEATURES]
        rows.append((f"r{i % 3}", i, *v, int((v[1] or 0) + 0.5 * (v[2] or 0) + 0.2 * r.uniform(-1, 1) > 0)))
    return spark.createDataFrame(rows, ", ".join(["resource_id string", "n int", *(f"{c} double" for c in FEATURES), "label int"])).withColumn("week", F.date_add(F.lit("2024-01-01"), F.col("n"))).repartition(3)


@pytest.fixture(scope="module")
def fitted(labelled):
    return models.fit(labelled, "lightgbm", ["n"], rounds=6)


def test_stored_model_scores_alike_and_explains(spark, labelled, fitted, tmp_path):
    root = f"file://{tmp_path}/m"
    none = store.predict(spark, root, labelled)
    assert {r.error for r in none.collect()} == {"no_model_available"} and store.runs(spark, root).count() == 0
    store.save(models.fit(models.synthetic(spark, 40), "lightgbm", ["id"], rounds=2), models.synthetic(spark, 40), root, "run-0")
    made = store.predict(spark, root, labelled)
    assert made.first().data_mode == "synthetic_validation" and made.first().warning and made.first().top_features is None and "synthetic" in made.first().top_reason
    store.save(fitted, labelled, root, "run-1")
    other = spark.newSession()
    stored = store.load(other, root)
    assert stored.run_id == "run-1" and stored.scorer.n == 240 and stored.scorer.mode == "real"
    one, two = ({r.n: (r.raw_score, r.calibrated_probability) for r in s.score(labelled).collect()} for s in (fitted, stored.scorer))
    assert one == two
    out = {r.n: r for r in store.predict(spark, root, labelled).collect()}
    assert {r.run_id for r in out.values()} == {"run-1"} and all(r.is_real_data_model and r.n_examples == 240 and len(r.top_features) == 5 and r.top_reason is None for r in out.values())
    flat, names = store.explained(stored, labelled)
    for r in flat.collect():
        margin = r.base + sum(r.contributions)
        assert 1 / (1 + math.exp(-margin)) == pytest.approx(one[r.n][0], abs=1e-9)
        tops = sorted(zip(dict.fromkeys(names), r.contributions, strict=True), key=lambda t: (-abs(t[1]), t[0]))[:5]
        assert [t.feature for t in out[r.n].top_features] == [n for n, _ in tops]
    weight = {r.feature: r.importance for r in attribution.mean_absolute(flat, names).collect()}
    assert max(weight, key=weight.get) == FEATURES[1] and set(weight) == set(FEATURES)
    store.save(fitted, labelled.limit(0), root, "run-2")
    assert store.load(spark, root).run_id == "run-2" and store.runs(spark, root).count() == 3 and store.load(spark, root, prefer="synthetic_validation").run_id == "run-0"
    assert store.load(spark, root, "forest") is None


def test_forest_and_gate(spark, labelled, tmp_path):
    root = f"file://{tmp_path}/m"
    for kind in ("forest", "logistic"):
        store.save(models.fit(labelled, kind, ["n"], rounds=5), labelled, root, "run-1")
    stored = store.load(spark, root, "forest")
    scores = {r.n: r.raw_score for r in stored.scorer.score(labelled).collect()}
    flat, _ = store.explained(stored, labelled)
    assert all(r.base + sum(r.contributions) == pytest.approx(scores[r.n]) for r in flat.collect())
    assert {(r.top_features, r.top_reason) for r in store.predict(spark, root, labelled, "logistic").collect()} == {(None, "no tree model (logistic)")}
    assert "fewer" in store.predict(spark, root, labelled, "forest", min_rows=1000).first().top_reason


def test_folds_are_even_and_the_same_everywhere(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    a, b = (models.stratified(rows.repartition(p), ["id"], 5) for p in (1, 7))
    sizes = {(r.label, r.fold): r["count"] for r in a.groupBy("label", "fold").count().collect()}
    for label in (0, 1):
        mine = [n for (y, _), n in sizes.items() if y == label]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1
    assert sorted(a.collect()) == sorted(b.collect())


def test_cross_validation_scores_every_row_out_of_fold(spark, labelled):
    scored = models.out_of_fold(labelled, "logistic", ["n"], most=4).collect()
    assert len(scored) == 240 and len({r.n for r in scored}) == 240 and {r.fold for r in scored} == {0, 1, 2, 3}
    got = models.cross_validate(labelled, "logistic", ["n"], most=4).first()
    pos, neg = [r.p for r in scored if r.label], [r.p for r in scored if not r.label]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert got.n == 240 and got.cv_folds == 4 and got.roc_auc == round(auc, 3) > 0.8 and got.error is None
    assert got.accuracy == round(sum((r.p >= 0.5) == r.label for r in scored) / 240, 3) and got.brier == round(sum((r.p - r.label) ** 2 for r in scored) / 240, 3)
    few = models.cross_validate(labelled.where("label = 0"), "logistic", ["n"]).first()
    assert few.roc_auc is None and few.error == f"too few of a class for CV (pos=0, neg={len(neg)})"


def test_isotonic_calibration(spark, fitted, labelled):
    """Pool-adjacent-violators over the held-out scores, interpolated between its knots."""
    full, _ = models.with_indicators(labelled)
    held = models.stratified(full, ["n"], 10).where("fold < 3")
    raw = sorted((r.raw_score, r.label) for r in fitted.score(held.select(*labelled.columns)).collect())
    blocks = [[p, p, float(y), 1] for p, y in raw]
    merged = []
    for p, group in itertools.groupby(raw, key=lambda t: t[0]):
        ys = [y for _, y in group]
        merged.append([p, p, sum(ys) / len(ys), len(ys)])
    blocks = []
    for b in merged:
        blocks.append(b)
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            x, y = blocks[-2], blocks.pop()
            blocks[-1] = [x[0], y[1], (x[2] * x[3] + y[2] * y[3]) / (x[3] + y[3]), x[3] + y[3]]
    knots = sorted({(p, v) for lo, hi, v, _ in blocks for p in (lo, hi)})
    for r in fitted.score(labelled).collect():
        want = np.interp(r.raw_score, [p for p, _ in knots], [v for _, v in knots])
        assert r.calibrated_probability == pytest.approx(want, abs=1e-9)


def curve(rows):
    n_pos, n_neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    out = {}
    for p in {p for _, p in rows}:
        tp, fp = sum(y for y, q in rows if q >= p), sum(1 - y for y, q in rows if q >= p)
        out[p] = (tp, fp, n_pos, n_neg)
    return out


def test_running_sums_by_ranges(spark):
    r = random.Random(6)
    data = [("one", int(r.random() < 0.4), round(r.gauss(0, 1), 2)) for _ in range(3000)] + [("two", 1, 0.5)] * 40 + [(None, 0, -1e300), (None, 1, float("inf")), (None, 1, 1e300)]
    rows = spark.createDataFrame(data, "model string, y int, p double").repartition(6)
    got = metrics._steps(rows, ["model"]).collect()
    for m in ("one", "two", None):
        want = curve([(y, p) for k, y, p in data if k == m])
        assert {g.p: (g.tp, g.fp, g.all_pos, g.all_neg) for g in got if g.model == m} == want
    ranges = metrics.in_ranges(rows.where("model = 'one'").groupBy("p").count(), [], "p").groupBy("_range").count()
    assert ranges.count() > 100 and ranges.agg(F.max("count")).first()[0] < 20
    assert metrics._steps(rows.limit(0), ["model"]).count() == 0


@pytest.mark.parametrize("values", [[1e-11, 3e-11], [3e19, -1e19, 7.0], [1e300, -1e300, 1.0, 5e-324], [0.1] * 10, [2.0**-300, 2.0**300, -(2.0**300)], [0.0, -0.0], [1.7e308, 1.7e308]])
def test_means_are_exact_at_every_magnitude(spark, values):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*values, float("nan")])], "id int, x double").where("not isnan(x)").repartition(3)
    rows = rows.union(spark.createDataFrame([(99, None)], "id int, x double"))
    want = float(sum(map(Fraction, values)) / len(values))
    assert metrics.exact_means(rows, ["x"])["x"] == pytest.approx(want, rel=1e-15, abs=1e-300)
    got = {r.id: r.contribution for r in metrics.linear_attribution(rows, {"x": 1.0}, ["id"]).collect()}
    assert got[0] == pytest.approx(values[0] - want, abs=1e-300) and got[99] is None


def test_means_of_what_is_no_number(spark):
    rows = spark.createDataFrame([(1.0, float("nan"), None), (2.0, 1.0, None)], "a double, b double, c double")
    got = metrics.exact_means(rows, ["a", "b", "c"])
    assert got["a"] == 1.5 and math.isnan(got["b"]) and got["c"] is None
