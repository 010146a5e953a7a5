import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.operators import order_statistics as O

PROBS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_percentiles_of_small_tables(spark, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 100), 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r.value for r in O.exact_percentiles(df, ["x"], PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-12)


def test_percentiles_past_the_sketch_with_a_hot_value(spark):
    # A third of 1,000,000 rows holds one value; the bracket then counts that value once.
    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.abs(F.xxhash64("id") % 1000003) / 1000003.0).alias("x"),
        (F.col("id") % 3 == 1).cast("string").alias("g"),
        (F.xxhash64("id") % 97).cast("double").alias("y"),
    )
    for by in ([], ["g"]):
        got = O.exact_percentiles(df, ["x", "y"], PROBS, by)
        for c in ("x", "y"):
            want = df.groupBy(*by).agg(F.percentile(c, F.lit(PROBS)).alias("v")).collect()
            for row in want:
                mine = got.where(F.col("column") == c)
                mine = mine.where(F.col("g") == row.g) if by else mine
                values = {r.prob: r.value for r in mine.collect()}
                assert [values[p] for p in PROBS] == pytest.approx(row.v, rel=1e-12)


def test_percentiles_with_infinite_values_and_missed_brackets(spark, monkeypatch):
    values = [float("-inf")] * 3 + [float(i % 50) for i in range(400)] + [float("inf")] * 2
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.005, 0.5, 1.0]
    want = [sorted(values)[int(p * (len(values) - 1))] for p in probs]
    got = lambda: {r.prob: r.value for r in O.exact_percentiles(df, ["x"], probs).collect()}
    assert [got()[p] for p in probs if p != 0.005] == [w for p, w in zip(probs, want) if p != 0.005]
    assert O.exact_percentiles(df.limit(0), ["x"], probs).count() == 0
    # Sketches of eight values miss most ranks, so the brackets have to widen.
    monkeypatch.setattr(O, "SKETCH_SIZE", 8)
    monkeypatch.setattr(O, "_BRACKET", 0.0001)
    many = spark.range(20_000).select((F.xxhash64("id") % 10_007).cast("double").alias("x"))
    want = many.agg(F.percentile("x", F.lit(PROBS)).alias("v")).first().v
    found = {r.prob: r.value for r in O.exact_percentiles(many, ["x"], PROBS).collect()}
    assert [found[p] for p in PROBS] == pytest.approx(want, rel=1e-12)


def test_histogram_keeps_the_maximum_and_a_constant_column(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    rows = {r.bin: r.rows for r in O.histogram(df, "x").collect()}
    want, _ = np.histogram(range(101), bins=50)
    assert [rows[i + 1] for i in range(50)] == list(want)
    constant = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert sorted((r.bin, r.rows) for r in O.histogram(constant, "x").collect()) == [(1, 4)] + [(i, 0) for i in range(2, 51)]


def test_top_k_per_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    got = {(r.g, r.id) for r in O.top_k_per_group(df, ["g"], [F.desc("id")], 5).collect()}
    want = set()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.id)
    for g, ids in groups.items():
        want |= {(g, i) for i in sorted(ids)[-5:]}
    assert got == want


def test_positions_and_split(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int"))
    df = spark.range(2000).select(day.alias("day"), F.col("id").alias("k")).repartition(7)
    rows = O.with_position(df, ["day", "k"]).collect()
    assert [r.position for r in sorted(rows, key=lambda r: (r.day, r.k))] == list(range(2000))
    for share in (0.0, 0.8, 0.8123, 1.0):
        a, b = O.split_by_position(df, share, "day", ["k"])
        ordered = sorted((r.day, r.k) for r in df.collect())
        cut = int(2000 * share + 1e-9)
        assert sorted((r.day, r.k) for r in a.collect()) == ordered[:cut]
        assert sorted((r.day, r.k) for r in b.collect()) == ordered[cut:]


def test_split_refuses_what_is_not_a_date(spark):
    with pytest.raises(ValueError, match="must be a date"):
        O.split_by_position(spark.range(5).select(F.col("id").alias("day"), F.lit(1).alias("k")), 0.8, "day", ["k"])


def test_split_keeps_rows_without_a_date(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(dt.date(2024, 1, 1), i) for i in range(5)], "day date, k int")
    a, b = O.split_by_position(df, 0.8, "day", ["k"])
    assert (a.count(), b.count()) == (8, 2)
    a, b = O.split_by_position(df, 0.2, "day", ["k"])
    assert (a.count(), b.count(), b.where("day is null").count()) == (2, 8, 3)


def test_percentiles_of_many_columns_with_nulls_count_values_in_one_scan(spark):
    """Nulls, infinities, repeated and grouped values in fourteen columns at once; the table is read twice, not three times."""
    x = F.xxhash64("id")
    columns = {f"c{i}": F.when(F.col("id") % 13 != i, (x % (10 ** (i % 7 + 1))).cast("double")) for i in range(13)}
    df = spark.range(6000).withColumns({**columns, "c13": F.when(F.col("id") % 5000 == 0, F.lit(float("inf"))).otherwise(F.rand(1)), "g": F.col("id") % 3})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    names = [f"c{i}" for i in range(14)]
    counted = df.mapInArrow(count, df.schema)
    got = {(r.column, r.prob): r.value for r in O.exact_percentiles(counted, names, PROBS).collect()}
    assert seen.value == 2 * 6000
    grouped = {(r.g, r.column, r.prob): r.value for r in O.exact_percentiles(df, names, PROBS, ["g"]).collect()}
    for c in names:
        assert [got[c, p] for p in PROBS] == pytest.approx(df.agg(F.percentile(c, F.lit(PROBS)).alias("v")).first().v, rel=1e-12)
        for row in df.groupBy("g").agg(F.percentile(c, F.lit(PROBS)).alias("v")).collect():
            assert [grouped[row.g, c, p] for p in PROBS] == pytest.approx(row.v, rel=1e-12)


def test_top_k_without_salts_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id")
    top = O.top_k_per_group(df, ["g"], [F.desc("id")], 5, salts=0)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in O.top_k_per_group(df, ["g"], [F.desc("id")], 5).collect()}
