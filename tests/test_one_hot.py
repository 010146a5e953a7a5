import pytest
from pyspark.sql import functions as F

from sunledger.operators import one_hot as O


def vectors(df):
    return {r.k: (r.one_hot.width, list(r.one_hot.places), list(r.one_hot["values"])) for r in df.collect()}


def test_known_unknown_null_and_repeated_sources(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",), ("A",)], "source_id string")
    index = O.source_index(train)
    assert sorted(tuple(r) for r in index.collect()) == [("", 0, 4), ("A", 1, 4), ("a", 2, 4), ("b", 3, 4)]
    batch = spark.createDataFrame([(1, "b", 9), (2, "zz", 9), (3, None, 9), (4, "", 9), (5, "b", 9)], "k int, source_id string, place int")
    got = O.with_one_hot(batch, index)
    assert got.columns == ["k", "source_id", "place", "one_hot"]
    one = [1.0]
    assert vectors(got) == {1: (4, [3], one), 2: (4, [], []), 3: (4, [], []), 4: (4, [0], one), 5: (4, [3], one)}
    laid = {r.k: list(r.d) for r in got.select("k", O.dense().alias("d")).collect()}
    assert laid == {1: [0, 0, 0, 1], 2: [0] * 4, 3: [0] * 4, 4: [1, 0, 0, 0], 5: [0, 0, 0, 1]}


def test_without_sources_or_rows(spark):
    none = spark.createDataFrame([], "source_id string")
    batch = spark.createDataFrame([(1, "a")], "k int, source_id string")
    got = O.with_one_hot(batch, O.source_index(none))
    assert vectors(got) == {1: (0, [], [])}
    assert got.select(O.dense().alias("d")).first().d == []
    assert O.with_one_hot(batch.limit(0), O.source_index(batch)).count() == 0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_a_hundred_thousand_sources_and_a_hot_one(spark, threshold):
    ids = spark.range(150_000).select(F.when(F.col("id") >= 100_000, 7).otherwise(F.col("id")).alias("n"), F.col("id").alias("k"))
    df = ids.select("k", "n", F.format_string("s%07d", "n").alias("source_id"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        hot = O.with_one_hot(df, O.source_index(df))
        v = F.col("one_hot")
        wrong = (v["width"] != 100_000) | (F.size(v["places"]) != 1) | (v["places"][0] != F.col("n")) | (v["values"][0] != 1.0)
        assert hot.agg(F.count(F.lit(1)), F.count_if(wrong)).first() == (150_000, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
