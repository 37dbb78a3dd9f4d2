"""Injected models and clients: status machines, fallbacks, failures that leave a trace."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from millrace.functions import prompts, times
from millrace.functions import text as X
from millrace.operators import text, views
from millrace.sources import readers


def test_narration_states(spark):
    rows = [("ok", "ok", [1, 2], True), ("syn", "ok", [1], False), ("bad", "cites others", [9], True), ("none", "ok", [], True), ("down", "down", [1], True), ("late", "late", [1], True)]
    p = spark.createDataFrame(rows, "resource_id string, prompt string, evidence array<long>, is_real boolean").coalesce(1)

    def generate(prompt, seen={}):  # noqa: B006  counts its calls
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "down" or (prompt == "late" and seen[prompt] == 1):
            raise RuntimeError("no answer")
        return {"narrative": " A note. ", "citations": [{"signal_id": 77 if prompt == "cites others" else 1, "excerpt": "few words"}, {"signal_id": 1, "excerpt": " ".join(["w"] * 26)}, {"signal_id": "x"}]}

    got = {r.resource_id: r for r in text.explain(p, generate).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "syn": "ok", "bad": "invalid_citations", "none": "insufficient_evidence", "down": "llm_error", "late": "ok"}
    assert got["ok"].narrative == "A note." and [c.signal_id for c in got["ok"].citations] == [1] and got["ok"].evidence_count == 2
    assert got["syn"].narrative.startswith(text.DISCLAIMER) and got["bad"].narrative is None and got["late"].narrative == "A note."


def test_judgments_and_fallback(spark):
    asked = []

    def first(prompt):
        asked.append(prompt)
        if prompt == "boom":
            raise RuntimeError
        return None if prompt == "silent" else '{"tightening_probability": 0.5, "rationale": "so"}'

    second = lambda p: None if p == "silent" else '{"tightening_probability": 2}'
    rows = spark.createDataFrame([(1, "plain"), (2, "boom"), (3, "silent")], "id int, prompt string")
    got = {r.id: (r.tightening_probability, r.provider, r.error) for r in text.judge(rows, "id", [("a", first), ("b", second)]).collect()}
    assert got == {1: (0.5, "a", None), 2: (None, "b", "probability_out_of_range"), 3: (None, None, "llm_call_failed")}
    assert {r.error for r in text.judge(rows, "id", []).collect()} == {"no_llm_provider"}
    none = text.judge(rows, "id", []).first()
    assert (none.method, none.is_calibrated, none.is_real_data_model) == ("llm_reasoner", False, False)


@pytest.mark.parametrize(("raw", "error"), [('{"tightening_probability": NaN}', "unparseable_llm_output"), ('{"tightening_probability": "NaN"}', "probability_out_of_range"), ('{"tightening_probability": null}', "non_numeric_probability"), ('{"tightening_probability": [1]}', "non_numeric_probability"), ('{"tightening_probability": -0.1}', "probability_out_of_range"), ("[]", "unparseable_llm_output"), ("", "unparseable_llm_output"), ('{"tightening_probability": 1}', None)])
def test_judgment_errors(spark, raw, error):
    assert spark.range(1).select(text.validate_judgment(F.lit(raw))["error"]).first()[0] == error


def test_keys_take_turns():
    calls = []

    def fn(key, prompt):
        calls.append(key)
        if key == "spent":
            raise RuntimeError
        return prompt

    ask = text.rotating(["spent", "good"], fn)
    assert ask("x") == "x" and ask("y") == "y" and calls == ["spent", "good", "good"]
    assert text.rotating(["spent"], fn)("z") is None


def test_prompts(spark):
    row = spark.createDataFrame([("dram", [(1, None, "up"), (2, "u", None)], {"b": None, "a": 1.5})], "r string, e array<struct<signal_id:long,source_url:string,raw_text:string>>, f map<string,double>")
    j = row.select(prompts.judgment(F.col("r"), F.lit("1m"), F.col("f"), F.col("e"))).first()[0]
    assert "a = 1.5000\nb = unknown" in j and "- signal 1 (no address): up\n- signal 2 (u): " in j
    n = row.select(prompts.narration(F.col("r"), F.col("e"), F.lit(None).cast("double"), F.lit(None).cast("array<struct<feature:string,contribution:double>>"))).first()[0]
    assert "Model" not in n and "signal 1" in n
    assert "metadata" in row.select(prompts.demand(F.lit("x"), F.col("r"))).first()[0]


def test_fetch_leaves_a_trace(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, page int").coalesce(1)

    def client(term, page, seen={}):  # noqa: B006
        seen[term] = seen.get(term, 0) + 1
        if term == "b" or (term == "c" and seen[term] < 3):
            raise ValueError("busy")
        return [{"title": f"{term}{i}"} for i in range(page)]

    got = readers.fetch(keys, client, "title string").collect()
    rows, failed = readers.fetched(spark.createDataFrame(got, "title string, _key string, _error string"))
    assert sorted(r.title for r in rows.collect()) == ["a0", "c0", "c1", "c2"]
    assert [tuple(r) for r in failed.collect()] == [('{"page": 2, "term": "b"}', "ValueError: busy")]


def test_missing_csv_is_told_from_a_broken_one(spark, tmp_path):
    assert readers.csv_or_empty(spark, f"file://{tmp_path}/nothing", "a int")[1] is False
    (tmp_path / "x.csv").write_text("a\n1\n")
    rows, there = readers.csv_or_empty(spark, f"file://{tmp_path}/x.csv", "a int")
    assert there and rows.collect() == [(1,)]
    with pytest.raises(Py4JJavaError):
        readers.csv_or_empty(spark, "nosuch://x", "a int")


def test_small_helpers(spark):
    r = spark.range(1).select(X.to_json(a=F.lit(1), b=F.lit(None).cast("string")).alias("j"), times.utc_now().alias("t"), times.is_weekday(F.lit("2024-01-06").cast("timestamp")).alias("w")).first()
    assert r.j == '{"a":1,"b":null}' and r.t.endswith("Z") and len(r.t) == 20 and r.w is False
    board = spark.createDataFrame([("a", 1), ("b", 2)], "resource_id string, n int")
    assert views.resource_summary(board, "b").collect() == [("b", 2)] and views.resource_summary(board, "z").count() == 0
