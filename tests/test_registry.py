"""Every registered query of the library runs on the smallest tables; the entry point works; streaming forms run."""

import os

import pytest

from millrace import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.mark.parametrize("name", ["k10_features", "k8_price_labels", "v3_leaderboard", "s4_replace_groups", "k24_tag", "j9_similar_pairs"])
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_every_query_plans(spark):
    slow = {"k14_fit_predict", "k15_perceptron", "k17_predict", "k18_tree_drivers", "k19_folds", "k20_clusters", "k20_density", "v7_run"}  # fit or iterate while they plan
    for name, q in registry.QUERIES.items():
        if name not in slow:
            assert q(spark, SF).schema, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_streaming(spark, tmp_path):
    from millrace.streaming import windows

    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id % 3 AS k", "id").write.parquet(src)
    stream = spark.readStream.schema("k long, id long").parquet(src)
    for n in range(2):  # a replay from the start adds nothing
        windows.append_absent_stream(stream, str(tmp_path / "out"), ["k"], ["id"], str(tmp_path / f"cp{n}")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 1), (2, 2)]
