import datetime as dt

import pytest
from helpers import expected_trends, random_sites, series
from pyspark.sql import functions as F

from sunledger.operators.trends import analyze_trends, one_reading_per_day
from sunledger.streaming import trends as ST
from sunledger.streaming.trends import stream_trends


def check(rows, expected):
    assert len(rows) == len(expected)
    for row in rows:
        n, g, c, e, tenths = expected[(row.site_id, row.reading_date)]
        assert row.history_rows == n
        for name, (label, speed, change) in {"generation": g, "consumption": c, "efficiency": e}.items():
            assert row[f"{name}_trend"] == label
            assert row[f"{name}_speed"] == pytest.approx(speed, rel=1e-9, abs=1e-12)
            if change is None:
                assert row[f"{name}_change"] is None
            else:
                assert row[f"{name}_change"] == pytest.approx(change, rel=1e-9, abs=1e-12)
        assert row.risk_score == pytest.approx(tenths / 10)
        assert row.has_risk == (tenths > 3)


def test_against_plain_python(spark):
    df = random_sites(spark)
    check(analyze_trends(df).collect(), expected_trends(df.collect()))


@pytest.mark.parametrize("days", [1, 10, 400])
def test_chunked_series_gives_the_same_rows(spark, days):
    df = random_sites(spark)
    whole = analyze_trends(df)
    chunked = analyze_trends(df, chunk_seconds=days * 86_400)
    assert whole.exceptAll(chunked.select(whole.columns)).count() == 0
    assert chunked.count() == df.count()


def test_history_sizes_around_the_limits(spark):
    df = analyze_trends(series(spark, [(100, 50, 40)] * 9))
    rows = df.orderBy("reading_date").collect()
    assert [r.history_rows for r in rows] == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert [r.confidence for r in rows[:3]] == [0.0, 0.0, 0.0]
    assert rows[3].confidence == pytest.approx(3 / 7) and rows[8].confidence == 1.0
    assert rows[2].risk_message == "Datos insuficientes para predicción"
    assert rows[3].risk_message == "Sin riesgos detectados"


def test_risk_of_exactly_the_limit_is_no_risk(spark):
    # Consumption doubles every day, nothing else moves: 0.3 in total.
    df = analyze_trends(series(spark, [(100, 10 * 2**i, 50) for i in range(5)]))
    last = df.orderBy(F.desc("reading_date")).first()
    assert (last.risk_score, last.has_risk) == (0.3, False)


def test_generation_and_efficiency_risks_add_up_to_exactly_seven_tenths(spark):
    # Generation falls by 20 % a day, self consumption faster; four rows are too few for a degradation.
    values = [(1000 * 0.8**i, 100, 900 * 0.6**i) for i in range(5)]
    last = analyze_trends(series(spark, values)).orderBy(F.desc("reading_date")).first()
    assert (last.risk_score, last.has_risk) == (0.7, True)
    assert last.degradation_slope is None


def test_degradation_skips_days_without_generation(spark):
    shares = [0.9, 0.85, None, 0.8, 0.75, 0.7, None]
    values = [(0, 10, 0) if s is None else (100, 10, 100 * s) for s in shares] + [(100, 10, 50)]
    last = analyze_trends(series(spark, values)).orderBy(F.desc("reading_date")).first()
    assert last.degradation_slope == pytest.approx(-0.05)
    values[1] = (0, 10, 0)  # four productive days are too few
    last = analyze_trends(series(spark, values)).orderBy(F.desc("reading_date")).first()
    assert last.degradation_slope is None


def test_five_documented_history_rows_stay_without_risk(spark):
    values = [(50000 - 1000 * i, 45000 + 1000 * i, 950) for i in range(6)]
    last = analyze_trends(series(spark, values)).orderBy(F.desc("reading_date")).first()
    assert last.generation_trend == "estable" and last.consumption_trend == "estable"
    assert last.risk_score == 0 and last.confidence == pytest.approx(5 / 7)


def test_one_reading_per_day_is_the_same_on_any_partitioning(spark):
    df = random_sites(spark, sites=2, days=20)
    twice = df.unionAll(df.withColumn("source_id", F.lit("zz")).withColumn("generation_wh", F.lit(1.0)))
    a = one_reading_per_day(twice.repartition(1))
    b = one_reading_per_day(twice.repartition(7))
    assert a.count() == df.count() and a.exceptAll(b).count() == 0
    assert a.where("source_id = 'zz'").count() == 0


SCHEMA = "site_id string, reading_date date, generation_wh double, consumption_wh double, self_consumption_wh double"


def arrive(spark, folder, part):
    """One more arrival for a stream of trends; returns what it has stored so far, in order and late."""
    part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    where = [str(folder / p) for p in ("out", "late", "check")]
    stream_trends(stream, *where, once=True).awaitTermination()
    return spark.read.parquet(where[0]), spark.read.parquet(where[1])


def test_stream_in_several_batches_equals_batch_job(spark, tmp_path):
    df = random_sites(spark, sites=3, days=40)
    cuts = [dt.date(2023, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2030, 1, 1)]
    late_row = df.where("site_id = 'S0'").orderBy("reading_date").limit(1)
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        part = df.where((F.col("reading_date") >= start) & (F.col("reading_date") < end))
        in_order, late = arrive(spark, tmp_path, part.unionAll(late_row) if i == 2 else part)
    check(in_order.collect(), expected_trends(df.collect()))
    assert late.count() == 1


def test_stream_sets_readings_without_a_date_or_of_a_known_day_apart(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    for days in ([day(10), day(11), None], [day(2), None, day(12), day(12)]):
        rows = [(site, d, 5.0 + i, 4.0, 3.0) for i, d in enumerate(days) for site in ("s", None)]
        in_order, late = arrive(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.site_id, r.reading_date, r.history_rows) for r in in_order.collect()), key=str)
    assert got == sorted(((s, day(d), n) for s in ("s", None) for n, d in enumerate((10, 11, 12))), key=str)
    assert sorted((r.reading_date for r in late.where("site_id = 's'").collect()), key=str) == [day(2), day(12), None, None]
    assert {r.generation_wh for r in in_order.where("reading_date = '2024-01-12'").collect()} == {7.0}  # the smallest of the day


def test_one_site_with_very_many_readings_in_a_batch(spark, tmp_path):
    """200,000 days of one site, and one of its days 200,000 times again."""
    n = 200_000
    days = spark.range(n).select(F.lit("s").alias("site_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("reading_date"),
                                 (F.col("id") % 50 + 1.0).alias("generation_wh"), F.lit(1.0).alias("consumption_wh"), F.lit(1.0).alias("self_consumption_wh"))
    again = days.limit(1).crossJoin(spark.range(n)).drop("id")
    in_order, late = arrive(spark, tmp_path, days.unionAll(again))
    assert (in_order.count(), late.count()) == (n, n)
    assert in_order.where("history_rows = 7").count() == n - 7


def test_remembered_readings_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FULL_EVERY", 3)
    df = random_sites(spark, sites=2, days=20)
    days = [r[0] for r in df.select("reading_date").distinct().orderBy("reading_date").collect()]
    for i in range(8):
        part = df.where(F.col("reading_date").isin(days[i * 3 : i * 3 + 3])).where(f"site_id = 'S0' OR {i} % 4 = 0")
        in_order, _ = arrive(spark, tmp_path, part)
    seen = df.where(F.col("reading_date").isin([d for i in range(0, 8) for d in days[i * 3 : i * 3 + 3]]))
    early = F.col("reading_date").isin([d for i in range(0, 8, 4) for d in days[i * 3 : i * 3 + 3]])
    whole = seen.where((F.col("site_id") == "S0") | early)
    check(in_order.collect(), expected_trends(whole.collect()))
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "check" / "last-readings").iterdir() if p.name.startswith("batch="))
    assert left == [3, 4, 5, 6, 7]
    state = ST.LastReadings(spark, str(tmp_path / "check" / "last-readings"))
    want = {(r.site_id, min(7, r["count"])) for r in whole.groupBy("site_id").count().collect()}
    assert {(r.site_id, r["count"]) for r in state.before(8).groupBy("site_id").count().collect()} == want
    # A replay of the last batch finds the state before it, and stores the same.
    assert state.before(7).exceptAll(state.before(7)).count() == 0 and state.before(7).where("site_id = 'S0'").count() == 7


def test_each_finding_is_spelt_out_once_in_the_plan(spark):
    """Score, flag and message share the findings; repeated in each, the compiled code is too large for the JVM to optimise."""
    rows = [("s", f"2024-01-{d:02d}", 100.0 - 9 * d, 10.0 * 1.3**d, 50.0 / d) for d in range(1, 11)]
    schema = "site_id string, reading_date string, generation_wh double, consumption_wh double, self_consumption_wh double"
    df = spark.createDataFrame(rows, schema).withColumn("reading_date", F.to_date("reading_date"))
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        analyzed = analyze_trends(df)
        assert analyzed._jdf.queryExecution().optimizedPlan().toString().count("round(degradation_slope") == 1
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    last = analyzed.orderBy(F.desc("reading_date")).first()
    assert (last.risk_score, last.has_risk) == (0.7, True) and last.risk_message.count(";") == 1
    first = analyzed.orderBy("reading_date").first()
    assert (first.risk_score, first.has_risk, first.risk_message) == (0.0, False, "Datos insuficientes para predicción")


def test_a_row_gets_its_history_without_sliding_frames(spark):
    """Each sliding frame goes through its rows again for each reading; its generated code grows with every measure."""
    plan = analyze_trends(random_sites(spark))._jdf.queryExecution().executedPlan().toString()
    assert "lag(" in plan and "regr_slope" not in plan and "collect_list" not in plan


def test_slope_and_mean_skip_rows_as_sql_does(spark):
    """The degradation slope and the mean change equal Spark's own aggregates over the seven rows before."""
    df = random_sites(spark, sites=8, days=80, seed=11)
    w = "(PARTITION BY site_id ORDER BY reading_date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    df.createOrReplaceTempView("slope_readings")
    plain = spark.sql(f"""
        WITH a AS (SELECT *, lag(generation_wh) OVER (PARTITION BY site_id ORDER BY reading_date) AS p,
            sum(CAST(generation_wh > 0 AS INT)) OVER (PARTITION BY site_id ORDER BY reading_date) AS idx,
            CASE WHEN generation_wh > 0 THEN self_consumption_wh / generation_wh END AS y FROM slope_readings),
        b AS (SELECT *, CASE WHEN p > 0 THEN (generation_wh - p) / p END AS c FROM a)
        SELECT site_id, reading_date, CASE WHEN count(y) OVER {w.format(7)} >= 5 THEN regr_slope(y, idx) OVER {w.format(7)} END AS slope,
            abs(avg(c) OVER {w.format(6)}) AS speed, collect_list(generation_wh) OVER {w.format(5)} AS recent FROM b""")
    expected = {(r.site_id, r.reading_date): r for r in plain.collect()}
    for row in analyze_trends(df).collect():
        own = expected[(row.site_id, row.reading_date)]
        assert (row.degradation_slope is None) == (own.slope is None)
        assert own.slope is None or row.degradation_slope == pytest.approx(own.slope, rel=1e-9, abs=1e-13)
        assert row.generation_recent is None or (row.generation_speed, row.generation_recent) == (own.speed, own.recent)


def test_only_readings_of_late_days_are_stored_in_between(spark, tmp_path, monkeypatch):
    stored, real = {}, ST.materialize

    def counted(df, name):
        table = real(df, name)
        stored.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(ST, "materialize", counted)
    df = random_sites(spark, sites=4, days=40).select("site_id", "reading_date", "generation_wh", "consumption_wh", "self_consumption_wh")
    first, second = (df.where(F.col("reading_date") < dt.date(2024, 1, 15)), df.where(F.col("reading_date") >= dt.date(2024, 1, 15)))
    arrive(spark, tmp_path, first)
    again = second.where("site_id = 'S1'").orderBy("reading_date").limit(1)
    old = first.where("site_id = 'S2'").orderBy("reading_date").limit(1)
    undated = old.withColumn("reading_date", F.lit(None).cast("date"))
    in_order, late = arrive(spark, tmp_path, second.unionAll(again).unionAll(again.withColumn("generation_wh", F.lit(1e9))).unionAll(old).unionAll(undated))
    # Two of a day's three readings, one that comes again and one without a date are late.
    assert stored == {"newest": [0, 4], "late-days": [0, 3], "late-rows": [0, 5]}
    assert in_order.count() == df.count() and late.count() == 4 and late.where("generation_wh = 1e9").count() == 1
    check(in_order.collect(), expected_trends(df.collect()))


def test_readings_of_an_arrival_are_shuffled_by_site_and_day_only(spark):
    """What is stored of a batch in order comes straight from the batch, without a shuffle of its measures."""
    batch = random_sites(spark, sites=3, days=30)
    remembered = spark.createDataFrame([], ST._REMEMBERED).drop("batch")
    new, late = ST.arrivals(batch, remembered)
    rows = {tuple(r) for r in new.collect()}
    assert rows == {tuple(r) for r in batch.select(new.columns).collect()} and late.count() == 0
    days = ST._late_days(batch, remembered)
    assert days.columns == ["_site", "_day", "_kept"] and days.count() == 0


def test_one_reading_per_day_keeps_undated_rows_and_sites_without_a_name(spark):
    rows = [("x", site, d, g, 1.0, 1.0, 0.0, 0.0) for site in ("s", None) for d, g in ((None, 1.0), (None, 1.0), (dt.date(2024, 1, 1), 9.0), (dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 2), 5.0))]
    df = spark.createDataFrame(rows, random_sites(spark, sites=1, days=1).schema)
    got = sorted(((r.site_id, r.reading_date, r.generation_wh) for r in one_reading_per_day(df).collect()), key=str)
    want = [(s, d, g) for s in ("s", None) for d, g in ((None, 1.0), (None, 1.0), (dt.date(2024, 1, 1), 2.0), (dt.date(2024, 1, 2), 5.0))]
    assert got == sorted(want, key=str)
