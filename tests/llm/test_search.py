"""Ranked search, whitening and approximate neighbours against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import kmtree, ranking, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("n", "terms", "tfs", "rank", "score", "item_no", "leaf", "v", "x", "copy", "qno", "place", "limb", "value", "component")


def clash(df):
    return df.withColumns({c: F.lit("own") for c in CLASH})


# 11


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_ranking(docs, items, k=20):
    terms = [TERM.findall(lowered(t)) for _, t in docs]
    docs_n, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for name, text in items:
        found = []
        for (doc, _), t in zip(docs, terms, strict=True):
            tf = Counter(t)
            score = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * (75 + 25 * len(t) * docs_n // total))) for x in TERM.findall(lowered(text)) if x in tf)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
        out += [(name, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def corpus(n=600, seed=1):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["é", "Ünï", "日本", "A1", "x-y", "don't"]
    say = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(k))
    docs = [(i, say(r.randint(1, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(90)]  # ties across ranges
    docs += [(None, docs[7][1]), (None, say(9)), (3, docs[3][1]), (3, say(5)), (n + 91, None), (n + 92, ""), (n + 93, "!?-- \x7f"), (n + 94, say(30_000)), (n + 95, "W1" * 4000)]
    items = [(i, say(r.randint(1, 30))) for i in range(25)]
    items += [(90, docs[7][1]), (91, None), (92, ""), (93, "nowhereatall"), (94, "w1 w1 w1 W1"), (5, say(4)), (None, say(4)), (95, say(3000))]
    return docs, items


def test_ranking(spark):
    docs, items = corpus()
    d = clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    q = clash(spark.createDataFrame(items, "item_id long, text string"))
    want = brute_ranking(docs, items)
    assert sorted((tuple(r) for r in ranking.search(d, q).collect()), key=str) == want
    assert sorted((tuple(r) for r in ranking.search(d, q, max_terms=300).collect()), key=str) == want  # many blocks of items


def test_ranking_of_nothing(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    blank = docs.withColumn("text", F.lit("?"))
    assert not ranking.search(docs.limit(0), items).count() and not ranking.search(docs, items.limit(0)).count() and not ranking.search(blank, items).count()


def test_tree_prunes_and_opens_ties():
    r = np.random.default_rng(2)
    n, width = 4000, 50
    doc, term = np.nonzero(r.random((n, width)) < 0.1)
    impact = r.integers(1, 1000, len(doc)) * np.where(doc // 200 == 3, 30, 1)
    tree = ranking.MaxTree(n, doc, term, impact)
    place, count = np.array([3, 8, 20, 41]), np.array([1, 2, 1, 1])
    dense = np.zeros((n, width), np.int64)
    dense[doc, term] = impact
    score = dense[:, place] @ count
    ids = r.permutation(n)
    best = ranking.Best(20, 0).of(ids, np.zeros(n, bool))
    opened = tree.search(place, count, best)
    order = np.lexsort((ids, -score))[:20]
    assert best.score.tolist() == score[order].tolist() and best.id.tolist() == ids[order].tolist() and opened < n // ranking.LEAF // 2
    flat = ranking.MaxTree(n, np.arange(n), np.zeros(n, np.int64), np.full(n, 5))  # all scores tie: every node's bound equals the k-th score
    best = ranking.Best(20, 0).of(ids, np.zeros(n, bool))
    flat.search(np.array([0]), np.array([1]), best)
    assert best.id.tolist() == list(range(20))


def test_norms_beyond_64_bits():
    n = np.array([0, 7, 3_000_000_000])
    assert ranking.norms(n, 10**10, 10**12).tolist() == [75 + 25 * int(x) * 10**10 // 10**12 for x in n]


# 12


def vectors(spark, rows):
    typed = [(i, v and [c if c is None else float(c) for c in v]) for i, v in rows]
    return clash(spark.createDataFrame(typed, "vec_id long, embedding array<float>"))


ODD = [(None, [0.5] * 6), (900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [float("inf"), 0, 0, 0, 0, 0]), (904, [0.25, 0.5]), (905, []), (7, [0.125] * 6), (906, [0.0] * 6)]


def test_whitening(spark):
    r = np.random.default_rng(5)
    raw = r.normal(size=(400, 6)).astype(np.float32) * np.array([3, 2, 1, 0.5, 0.3, 0.1], np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(raw)] + [(1000 + i, [float(c) for c in raw[0]]) for i in range(300)] + ODD
    got = whitening.whiten(vectors(spark, rows).repartition(6)).toPandas()
    kept = [(i, [math.floor(256 * c) for c in v] + [0] * (6 - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(kept) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for c in range(1, 5):
        part = got[got.component == c]
        white = [float(sum((Fraction(x[i]) - Fraction(s[i], n)) * Fraction(u[i, c - 1]) for i in range(6))) / math.sqrt(e[c - 1]) for _, x in kept]
        dev = [sum((n * x[i] - s[i]) ** 2 for i in range(6)) for _, x in kept]
        name = lambda i: -1 if i is None or i != i else int(i)
        sign = next(z for z in (1, -1) if np.allclose(sorted(z * part.whitened), sorted(white), atol=1e-9))
        key = lambda i, d, w: (name(i), int(d), round(w, 7) + 0.0)
        assert sorted(key(i, d, sign * w) for i, d, w in zip(part.vec_id, part.deviation, part.whitened, strict=True)) == sorted(key(i, d, w) for (i, _), d, w in zip(kept, dev, white, strict=True))
        assert np.allclose(part.explained, e[c - 1] / np.trace(cov)) and (part.deviation_digits == part.deviation.astype("int64").astype(str)).all()


def test_whitening_of_large_entries_is_exact():
    r = np.random.default_rng(6)
    x = r.integers(-(1 << 62), 1 << 62, (50, 5))
    shift = [int(v) for v in x[0]]
    batch = pa.record_batch([pa.array(x.tolist(), pa.list_(pa.int64()))], ["x"])
    total = Counter()
    for b in whitening._scatter(shift)(iter([batch])):
        for row in b.to_pylist():
            total[row["place"]] += row["value"] << (whitening.LIMB * row["limb"])
    o = x.astype(object) - np.array(shift, object)
    assert [total[1 + i] for i in range(5)] == list(o.sum(0)) and [total[6 + i] for i in range(15)] == list((o.T @ o)[np.triu_indices(5)]) and total[0] == 50


def test_whitening_of_flat_and_large_vectors(spark):
    big = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e6, 3.0])]
    got = whitening.whiten(vectors(spark, big)).toPandas()
    assert len(got) == 6 and got.deviation.isna().any() and got.deviation_digits.str.len().max() > 19
    flat = whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).toPandas()
    assert set(flat.n) == {1} and flat.whitened.isna().all() and flat.explained.isna().all() and flat.identity_error.isna().all() and set(flat.deviation) == {0}
    line = whitening.whiten(vectors(spark, [(1, [0.5, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])])).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component == 2].whitened.isna().all() and line.identity_error.max() < 1e-9
    assert not whitening.whiten(vectors(spark, [(1, None), (2, [])])).count()
    with pytest.raises(ValueError, match="max_dims"):
        whitening.whiten(vectors(spark, big), max_dims=1)


# 13


def brute_nearest(rows, k=20, every=20):
    live = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    dims = max((len(v) for _, v in live), default=0)
    x = np.array([list(v) + [0.0] * (dims - len(v)) for _, v in live])
    out = {}
    for a, (i, v) in enumerate(live):
        if i % every == 0:
            s = (x[a] * x).sum(1)
            out[i, v] = sorted(((-s[b], live[b][0]) for b in range(len(live)) if b != a))[:k]
    return out


def fixture(n, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(8, 16))
    x = (centre[r.integers(0, 8, n)] + 0.6 * r.normal(size=(n, 16))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(n + i, [float(c) for c in x[40]]) for i in range(n // 2)]  # a third are one vector
    return rows + [(5, [0.5] * 16), (60, [0.5] * 16), (60, [0.5] * 16), (20, [2.0]), (21, [3.0, 1.0])] + ODD


def test_neighbours(spark):
    rows = fixture(3000)
    want = brute_nearest(rows)
    got = kmtree.nearest(vectors(spark, rows), leaf_rows=64, branch=4).toPandas()
    assert len(got) == 20 * len(want)
    by_id = Counter(i for i, _ in want)
    share = []
    for (i, _), near in want.items():
        if by_id[i] == 1:
            mine = got[got.query_id == i].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, 21)) and i not in mine.vec_id.tolist()
            pairs = list(zip(-mine.score, mine.vec_id, strict=True))
            assert pairs == sorted(pairs)
            share.append(len({b for _, b in near} & set(mine.vec_id)) / 20)
    assert np.mean(share) >= 0.9
    same = [near for (i, v), near in want.items() if i == 40][0]
    mine = got[got.query_id == 40].sort_values("rank")
    assert mine.vec_id.tolist() == [b for _, b in same] and np.allclose(mine.score, [-s for s, _ in same])  # ties by id among the copies


def test_neighbours_visit_part_of_the_leaves():
    r = np.random.default_rng(3)
    centre = 5 * r.normal(size=(40, 8))
    x = centre[r.integers(0, 40, 4000)] + 0.2 * r.normal(size=(4000, 8))
    tree = kmtree.Tree(x[:2000], 2.0, 100, 4, 1000)
    leaf = tree.assign(x)
    held = np.bincount(leaf, minlength=tree.leaves)
    met = [len(set(np.argsort(-(x @ q))[:20]) & set(np.flatnonzero(np.isin(leaf, o)))) / 20 for q, o in zip(x[::200], tree.orders(x[::200], tree.leaves // 4, held, 21), strict=True)]
    assert tree.leaves > 20 and held.sum() == 4000 and np.mean(met) >= 0.95
    assert all(len(o) == tree.leaves for o in tree.orders(x[:3], 1, held, 10**9))


def test_few_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), *ODD[1:6]]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in kmtree.nearest(vectors(spark, rows)).collect())
    assert got == [(0, 1, 3), (0, 2, 904), (0, 3, 20), (20, 1, 3), (20, 2, 904), (20, 3, 0)]
    assert not kmtree.nearest(vectors(spark, ODD[1:4])).count() and not kmtree.nearest(vectors(spark, [(0, [1.0])])).count() and not kmtree.nearest(vectors(spark, [(1, [1.0])])).count()


def test_visits_are_listed_by_shelf_in_small_batches():
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 8))
    tree = kmtree.Tree(x, 1.0, 20, 8, 1000)
    held = np.bincount(tree.assign(x), minlength=tree.leaves)
    shelf = kmtree.shelves(held, 500)
    size = np.bincount(shelf, held)
    assert tree.leaves > 150 and len(size) in range(6, 10) and size.max() <= 500 + held.max() and (np.diff(shelf) >= 0).all()
    batch = pa.record_batch([pa.array(np.arange(2000)), pa.array(np.arange(2000)), pa.array(list(x[:2000]))], ["qno", "qid", "qv"])
    got = list(kmtree._visits(SimpleNamespace(value=tree), 8, tree.leaves // 2, 10, held, shelf, 21)([batch]))
    assert max(b.num_rows for b in got) <= kmtree.ASKED * len(size)  # a row a shelf; before, all queries times all leaves in one batch
    rows = [q for b in got for q in b.to_pylist()]
    assert all(set(shelf[q["near"] + q["far"]]) == {q["shelf"]} for q in rows)
    orders = list(tree.orders(x[:2000], tree.leaves // 2, held, 21))
    for n in (0, 777, 1999):
        mine = [q for q in rows if q["qno"] == n]
        assert sorted(i for q in mine for i in q["near"]) == sorted(orders[n][:10]) and sorted(i for q in mine for i in q["far"]) == sorted(orders[n][10:])


def test_a_hot_shelf_is_dealt_in_pages_and_blocks(spark, monkeypatch):
    rows = fixture(3000)
    want = sorted(map(tuple, kmtree.nearest(vectors(spark, rows), leaf_rows=64, branch=4, recall=1.0).collect()))
    monkeypatch.setattr(kmtree, "SHELF_CELLS", 16 * 40)
    assert sorted(map(tuple, kmtree.nearest(vectors(spark, rows), leaf_rows=64, branch=4, recall=1.0).collect())) == want
