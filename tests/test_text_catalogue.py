"""Dictionary, fuzzy and embedding layers against matching and scoring every term."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dictionary, embedding, fuzzy, text

TEXTS = ["Samsung's new DRAM line", "the SAMSUNG", "Samsungs", "xSamsung", "AT&T and +plus", "a+plus b", "high-bandwidth memory", "Ångström ångström", "STRASSE straße", "日本 テスト", "", None, "under_score score", "MU", "mu\nMu", "emu", "ſamſung K"]
TERMS = ["Samsung", "at&t", "+plus", "High-Bandwidth Memory", "ÅNGSTRÖM", "strasse", "straße", "日本", "score", "MU", "k", "", None, "memory", "samsung", "e.u"]


def test_terms_match_as_a_regex_does(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").withColumn("extra", F.lit(1))
    terms = spark.createDataFrame(list(enumerate(TERMS)), "n int, term string")
    got = sorted((r.id, r.n) for r in dictionary.match_terms(docs, "t", terms, ["id"]).collect())
    want = sorted((i, n) for i, t in enumerate(TEXTS) for n, q in enumerate(TERMS) if t and q and re.search(rf"\b{re.escape(q)}\b", t, re.IGNORECASE))
    assert got == want and len(want) > 15
    whole = dictionary.match_terms(docs, "t", terms)
    assert whole.columns == ["id", "t", "extra", "n", "term"] and whole.count() == len(want)


def test_folding_keeps_every_length():
    odd = "ΑΣ Σς İıI ſ K µμ ß ẞ ŉ ǅ Ａ Åå"
    assert len(dictionary.folded(odd)) == len(odd) and dictionary.folded(odd) == "".join(map(dictionary._one, odd)) == dictionary.folded(dictionary.folded(odd))


def test_large_catalogue_in_one_pass(spark):
    docs = spark.range(300).select("id", F.concat(F.lit("about item"), F.col("id").cast("string"), F.lit(" and item7.")).alias("t"))
    terms = spark.range(100_000).select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("term"), "id").withColumnRenamed("id", "n")
    out = dictionary.match_terms(docs, "t", terms, ["id"])
    assert out.count() == 2 * 300 - 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="at most"):
        dictionary.match_terms(docs, "t", terms.union(terms))


def brute_ratio(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for i in range(1 - len(a), len(b)):
        w = b[max(0, i) : i + len(a)]
        row = [0] * (len(w) + 1)
        for c in a:
            row = [0, *(0 for _ in w)] if not w else _next(row, c, w)
        best = max(best, 200.0 * row[-1] / (len(a) + len(w)))
    return best


def _next(row, c, w):
    out = [0]
    for j, x in enumerate(w):
        out.append(row[j] + 1 if x == c else max(row[j + 1], out[j]))
    return out


def test_fuzzy_index_loses_nothing():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdé") for _ in range(n))
    aliases = [word(r.randint(4, 20)) for _ in range(150)] + [word(90), "aaaa", "aaaaaaaaaa"]
    texts = [word(r.randint(1, 60)) for _ in range(60)]
    for a in aliases[:80]:
        i = r.randrange(len(a))
        texts.append(word(8) + a[:i] + r.choice(["", "x", "zz"]) + a[i + r.randint(0, 2) :] + word(8))
    texts += [a[1:] for a in aliases[:10]] + [aliases[150], aliases[150][:60] + "x" + aliases[150][61:]]
    index = fuzzy.Index(aliases, 88.0)
    hits = 0
    for t in texts:
        scores = [fuzzy.partial_ratio(a, t) for a in aliases]
        reach = {i for i, s in enumerate(scores) if s >= 88.0}
        assert reach <= set(index.candidates(t).tolist())
        top = max(scores)
        assert index.best(t) == ((scores.index(top), top) if top >= 88.0 else None)
        hits += bool(reach)
    assert hits > 40
    for _ in range(60):
        a, b = word(r.randint(1, 12)), word(r.randint(1, 25))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(brute_ratio(a, b))
    wide = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    names = [wide(12) for _ in range(500)]
    assert sum(len(fuzzy.Index(names, 88.0).candidates(wide(40) + n + wide(40))) for n in names[:50]) < 50 * 10


def test_equal_scores_go_to_the_first_in_the_catalogue(spark):
    aliases = spark.createDataFrame([("z", "abcdefghij", 1), ("a", "abcdefghij", 2), ("b", "Long Name Corp", 3), ("c", "Name Corp", 4), ("d", "Name Corp", 0)], "producer_id string, term string, position int")
    docs = spark.createDataFrame([(1, "xx abcdefghiX yy"), (2, "the long name corp"), (3, "name corp"), (4, "nothing")], "id long, t string")
    got = {r.id: (r.producer_id, r.confidence, r.method) for r in text.resolve(docs, "id", "t", aliases).collect()}
    assert got == {1: ("z", 0.9, "fuzzy"), 2: ("b", 0.99, "exact_alias"), 3: ("d", 0.99, "exact_alias"), 4: (None, 0.0, "unresolved")}
    assert {r.method: r.n for r in text.outcomes(text.resolve(docs, "id", "t", aliases)).collect()}["unresolved"] >= 1


def test_model_is_loaded_once_a_worker_and_called_by_batch(spark):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(texts):
            calls.add(1)
            return text.hashed_embedding(texts)

        return model

    rows = spark.range(400, numPartitions=1).select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("t"))
    got = embedding.embed(rows, "t", load, batch=100).collect()
    assert loads.value == 1 and calls.value == 4
    assert [r.embedding is None for r in got] == [r.id % 10 == 0 for r in got] and np.allclose(got[1].embedding, text.hashed_embedding(["text 1"])[0])

    def broken():
        raise RuntimeError("no model")

    assert all(r.embedding is None for r in embedding.embed(rows, "t", broken).collect())
    aliases = spark.createDataFrame([("s", "Samsung")], "producer_id string, term string")
    docs = spark.createDataFrame([(1, "weather report today"), (2, "Samsung")], "id long, t string")
    near = {"w": "weather report"}
    assert {r.id: r.method for r in text.resolve(docs, "id", "t", aliases, load=broken, descriptions=near).collect()} == {1: "unresolved", 2: "exact_alias"}
    assert {r.id: (r.method, r.producer_id) for r in text.resolve(docs, "id", "t", aliases, text.hashed_embedding, near).collect()}[1] == ("embedding", "w")


def test_names_that_begin_alike_are_not_all_scored(monkeypatch):
    names = [f"Supplier#{i:09d}" for i in range(1, 5001)]
    index, scored, ratio = fuzzy.Index(names, 88.0), [], fuzzy.partial_ratio
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda a, b: scored.append(a) or ratio(a, b))
    for i in (1, 70, 1234, 4999):
        scored.clear()
        got = index.best(f"News from {names[i][:8]}~{names[i][9:]}")
        assert got == (i, pytest.approx(100 * 17 / 18)) and len(scored) < 200  # all 5,000 before
        assert index.best(f"News from {names[i][:13]}x{names[i][14:]} and more") is not None
    assert index.best("Weather") is None
