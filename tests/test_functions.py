"""Column functions on hand-made vectors."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import times
from millrace.functions import vectors as V
from millrace.operators import fuzzy, text
from millrace.schemas import RISK_TIERS


def one(spark, col, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(col.alias("r")).first()["r"]


def test_stamps(spark):
    rows = [("20240630T114500Z",), ("2024-06-30",), ("2024-06-30T11:45:00",), (None,), ("not-a-date",), ("20240630",), ("20241399",)]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "s string").select(times.parse_ts(F.col("s"))).collect()]
    assert got == ["2024-06-30 11:45:00", "2024-06-30 00:00:00", "2024-06-30 11:45:00", "None", "None", "2024-06-30 00:00:00", "None"]


def test_weeks(spark):
    r = spark.createDataFrame([("2024-03-03",), ("2024-03-04",)], "d string").select(times.week_start(F.col("d").cast("date")).cast("string"), times.week_end(F.col("d").cast("date")).cast("string")).collect()
    assert [tuple(x) for x in r] == [("2024-02-26", "2024-03-03"), ("2024-03-04", "2024-03-10")]


def test_word_match(spark):
    cases = [("MU", "aluminum smelter update", False), ("MU", "shares of mu rose", True), ("c++", "about c++ x", False), ("élan", "Élan vital", True), ("a.b", "axb", False), ("Brand#1", "Brand#10", False)]
    got = spark.createDataFrame(cases, "t string, x string, e boolean").select(X.word_match(F.col("t"), F.col("x")).alias("g"), "e").collect()
    assert [r.g for r in got] == [r.e for r in got]


def test_text_helpers(spark):
    assert one(spark, X.slug(F.col("s")), s="DRAM (cheapest) Keepa!") == "dram__cheapest__keepa"
    assert one(spark, X.percent(F.col("p")), p=0.44) == "44.0%"
    assert spark.range(1).select(X.percent(F.lit(None).cast("double"))).first()[0] == "Not available"
    assert one(spark, X.query_terms(F.lit("HBM"), F.array(F.lit("hbm"), F.lit("High Bandwidth"), F.lit("x"))), s=1) == ["HBM", "High Bandwidth", "x"]
    assert one(spark, X.extract_json_object(F.col("s")), s='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.unit(a), s=1) == [0.6, 0.8] and one(spark, V.unit(z), s=1) == [0.0, 0.0]
    assert one(spark, V.cosine(a, z), s=1) == 0.0
    assert [one(spark, V.risk_tier(F.lit(p), RISK_TIERS), s=1) for p in (0.1, 0.3, 0.7, 0.8)] == ["Safe", "Watch", "Elevated", "Critical"]
    assert spark.range(1).select(V.risk_tier(F.lit(None).cast("double"), RISK_TIERS)).first()[0] == "Not scored"


def test_extraction_contract(spark):
    good = '{"event_type":"other","severity":5,"confidence":0.5,"entities":[],"reasoning":"r"}'
    cases = [(good, True), (f"Here:\n```json\n{good}\n```", True)]
    cases += [(good.replace('"severity":5', f'"severity":{v}'), False) for v in ("0", "11", "true", '"5"', "5.0")]
    cases += [(good.replace("0.5", "1.5"), False), (good.replace("[]", '"x"'), False), (good.replace('"r"', '" "'), False), ("nothing", False), (None, False), (good.replace("other", "odd"), False)]
    got = spark.createDataFrame(cases, "raw string, e boolean").select(text.validate_extraction(F.col("raw"))["ok"].alias("g"), "e", "raw").collect()
    assert [(r.raw, r.g) for r in got] == [(r.raw, r.e) for r in got]


def test_citations(spark):
    c = F.from_json(F.lit('[{"signal_id":1,"excerpt":" ok "},{"signal_id":999,"excerpt":"x"},{"signal_id":1,"excerpt":"' + "w " * 30 + '"}]'), "array<struct<signal_id:long,excerpt:string>>")
    v = one(spark, text.validate_citations(F.lit("Story."), c, F.array(F.lit(1).cast("long"))), s=1)
    assert [(x.signal_id, x.excerpt) for x in v.citations] == [(1, "ok")]
    assert one(spark, text.validate_citations(F.lit("Story."), c, F.array(F.lit(2).cast("long"))), s=1) is None
    assert one(spark, text.with_disclaimer(F.lit("x"), F.lit(False)), s=1).startswith("⚠")


def test_partial_ratio():
    assert fuzzy.partial_ratio("samsung", "the samsung plant") == 100.0
    assert fuzzy.partial_ratio("samsung", "the samsong plant") > 80
    assert fuzzy.partial_ratio("", "x") == 0.0
