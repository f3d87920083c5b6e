import pytest
from pyspark.sql import functions as F

from kindred.operators import audit as A
from kindred.operators import models as M
from kindred.streaming import events as E


def test_fit_rows_exclude_targets_of_other_folds(spark):
    rows = spark.createDataFrame([(1, -1), (1, 1), (1, 0), (0, 1), (2, 4)], "fold int, owner_fold int")
    assert sorted(map(tuple, M.fit_rows(rows, [1, 2]).collect())) == [(1, -1), (1, 1)]


def test_country_weights_give_equal_mass(spark):
    rows = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] + [("c", 0)], "country string, fold int")
    found = {r.country: r.weight for r in M.country_weights(rows, [1]).collect()}
    assert found == {"a": pytest.approx(2 / 3), "b": pytest.approx(2.0)}


def test_rank_auc_and_reliability(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (1.0, 1)], "p double, y int")
    assert M.rank_auc(rows).first().auc == pytest.approx((1 + 1 + 0.5 + 1 + 1 + 1) / 6)
    bins = {r.bin: r.n for r in M.reliability(rows).collect()}
    assert bins == {9: 2, 8: 2, 1: 1}


def test_fellegi_sunter_separates_agreement(spark):
    rows = spark.createDataFrame([(1, 1)] * 20 + [(0, 0)] * 80 + [(1, 0)] * 3, "a int, b int")
    found = {(r.a, r.b): r.match_probability for r in M.fellegi_sunter(rows, ["a", "b"]).collect()}
    assert found[(1, 1)] > 0.9 > 0.1 > found[(0, 0)]
    assert M.fellegi_sunter(rows.limit(0), ["a", "b"]).count() == 0


def test_mined_phrases(spark):
    rows = spark.createDataFrame([(f"e{i}", "main st 4", "main street 4") for i in range(10)], "e string, a string, b string")
    assert [(r.old, r.new, r.n) for r in M.mined_phrases(rows, "a", "b", "e").collect()] == [("st", "street", 10)]


def test_missing_spelling_raises(spark):
    rows = spark.createDataFrame([("abc",), ("é",)], "t string")
    known = spark.createDataFrame([("é", "e")], "n string, spelling string")
    assert sorted(r.s for r in M.transliterated(F.col("t"), known, rows, "s").collect()) == ["abc", "e"]
    with pytest.raises(Exception):  # noqa: B017
        M.transliterated(F.col("t"), known.limit(0), rows, "s").collect()


def test_out_of_fold_and_platt(spark):
    rows = spark.createDataFrame([(f"q{i}", f"t{i}", i % 3, -1, int(i % 2), float(i % 2) + 0.01 * (i % 5)) for i in range(90)], "source1_entity_id string, target_id string, fold int, owner_fold int, label int, x double")
    scored = M.out_of_fold(rows, ["x"], [0, 1, 2], iterations=2)
    assert scored.count() == 90 and M.rank_auc(scored.withColumn("y", F.col("label"))).first().auc == 1.0
    assert M.platt(scored)(scored).filter("calibrated between 0 and 1").count() == 90


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.range(200).select(F.col("id").alias("q"), (F.col("id") % 2).cast("double").alias("f"))
    r = M.bootstrap(rows, "f", 40).first()
    assert r.low <= r["mean"] <= r.high and r.high - r.low < 0.3


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("a",)], "n string")
    assert tuple(A.duplicate_groups(rows, [F.col("n")]).first()) == (1, 2, 3)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    at = "/root/testdata/sf0.001"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(at)
    query = E.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {(r.window_start, r.event_type): r.n for r in spark.sql("SELECT * FROM w").collect()}
    assert streamed == {(r.window_start, r.event_type): r.n for r in E.windowed(events).collect()} != {}


def test_views_are_maintained_by_batch(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    spark.createDataFrame([("S1-1", "Acme  Co.", "", "x")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    E.maintain_views(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").first().n == "acme co"
