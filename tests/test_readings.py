import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

import helpers
from sunledger import schema as S
from sunledger.functions import readings as R
from sunledger.operators import reports, sets
from sunledger.sinks import tables
from sunledger.sources import readings as sources
from sunledger.sources.history import history_readings, read_history_json, read_store
from sunledger.sources.readings import read_readings, skipped_files
from sunledger.streaming.folder import readings_stream

HEADER = "Fecha,Generación total,Consumo total,Autoconsumo,Energía suministrada a la red,Energía obtenida de la red"
UNITS = "[dd.MM.yyyy],[Wh],[Wh],[Wh],[Wh],[Wh]"


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder / name)


@pytest.fixture
def files(tmp_path):
    return [
        write(tmp_path, "23_04_NORTE_01012023-31122023.csv", HEADER, UNITS, "01.01.2023,100.5,80,70,30.5,10", "02.01.2023,x,80,70,30,10"),
        write(tmp_path, "datos_energia_SUR.csv", HEADER.replace("Fecha", "Fecha y hora", 1), "31.12.2023,10,20,5,5,15", "bad date,11,,5,5,15"),
    ]


def test_units_row_aliases_coercion_and_names(spark, files):
    rows = {(r.source_id, r.generation_wh): r for r in read_readings(spark, [*files, "/no/such/file.csv"]).collect()}
    assert set(rows) == {
        ("23_04_NORTE_01012023-31122023", 100.5),
        ("23_04_NORTE_01012023-31122023", None),
        ("SUR", 10.0),
        ("SUR", 11.0),
    }
    north = rows[("23_04_NORTE_01012023-31122023", 100.5)]
    assert (north.site_id, north.reading_date, north.grid_export_wh) == ("NORTE", dt.date(2023, 1, 1), 30.5)
    assert rows[("SUR", 11.0)].reading_date is None and rows[("SUR", 11.0)].consumption_wh is None
    assert read_readings(spark, files, drop_incomplete=True).count() == 2


def test_columns_by_name(spark, tmp_path, files):
    odd = write(tmp_path, "mixto.csv", " Consumo total , Empresa,Fecha,Generación total", '7,"Uno, S.A.",2023-05-06,9')
    by_name = read_readings(spark, [*files, odd, odd, str(tmp_path / "mix*.csv")])
    row = by_name.where("generation_wh = 9").first()
    assert (row.source_id, row.consumption_wh, row.self_consumption_wh) == ("Uno, S.A.", 7.0, None)
    assert row.reading_date == dt.date(2023, 5, 6)
    same = by_name.where("source_id != 'Uno, S.A.'")
    assert same.exceptAll(read_readings(spark, files).select(same.columns)).count() == 0
    assert same.count() == 4


def test_swapped_missing_and_many_columns_keep_their_values(spark, tmp_path):
    swapped = write(tmp_path, "a b.csv", "Fecha,Consumo total,Generación total", UNITS, "01.02.2023,7,9")
    many = ",".join(f"x{i}" for i in range(60))
    wide = write(tmp_path, "w[1].csv", f"{many},Generación total,Fecha", ",".join("0" for _ in range(60)) + ",5,02.02.2023")
    other = write(tmp_path, "no header.csv", "1,2,3", "4,5,6")
    rows = {r.source_id: r for r in read_readings(spark, [swapped, str(tmp_path / "w*.csv"), other]).collect()}
    assert (rows["a b"].generation_wh, rows["a b"].consumption_wh, rows["a b"].grid_import_wh) == (9.0, 7.0, None)
    assert (rows["w[1]"].generation_wh, rows["w[1]"].reading_date, rows["w[1]"].consumption_wh) == (5.0, dt.date(2023, 2, 2), None)
    assert len(rows) == 2
    assert [r.path.endswith("no%20header.csv") for r in skipped_files(spark, str(tmp_path / "*.csv")).collect()] == [True]


def test_the_first_line_is_the_header_whatever_the_lines_below_hold(spark, tmp_path):
    known = write(tmp_path, "n.csv", "Fecha,Generación total,Consumo total,Nota", "01.01.2023,5,6,Autoconsumo", "02.01.2023,7,8,Fecha")
    late = write(tmp_path, "late.csv", "a,b,c", HEADER, "01.01.2023,1,1,1,1,1")
    blank = tmp_path / "blank.csv"
    blank.write_bytes(("\ufeff\r\n \r\n" + "Generación total,Fecha\r\n9,03.01.2023\r\n").encode())
    rows = read_readings(spark, [known, late, str(blank)]).collect()
    assert sorted((r.source_id, r.generation_wh, r.reading_date.day) for r in rows) == [("blank", 9.0, 3), ("n", 5.0, 1), ("n", 7.0, 2)]
    assert [r.path.endswith("late.csv") for r in skipped_files(spark, str(tmp_path / "*.csv")).collect()] == [True]


def test_two_hundred_layouts_in_one_job(spark, tmp_path):
    names, want = HEADER.split(","), []
    for i in range(200):
        order = names[i % 6 :] + names[: i % 6]
        order.insert(i % 7, f"Otra {i}")
        cells = {"Fecha": "01.01.2023", names[1]: str(i), names[2]: str(i + 0.5)}
        write(tmp_path, f"s{i:03d}.csv", ",".join(order), ",".join(cells.get(n, '"x, y"') for n in order))
        want.append((f"s{i:03d}", float(i), i + 0.5, None))
    df = read_readings(spark, str(tmp_path / "*.csv"))
    assert sorted((r.source_id, r.generation_wh, r.consumption_wh, r.self_consumption_wh) for r in df.collect()) == want
    assert len(df.inputFiles()) == 200  # one scan


def test_a_file_of_several_splits_keeps_its_header(spark, tmp_path):
    lines = [f"{i % 28 + 1:02d}.01.2023,{i},Autoconsumo" for i in range(20_000)]
    big = write(tmp_path, "big.csv", "Fecha,Consumo total,Otra", UNITS, *lines)
    small = write(tmp_path, "small.csv", "Consumo total,Fecha", "5,01.01.2023")
    other = write(tmp_path, "other.csv", *[f"{i},{i}" for i in range(20_000)])
    settings = {"spark.sql.files.openCostInBytes": "1024", "spark.sql.files.maxPartitionBytes": "32768"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = read_readings(spark, [big, small, other])
        assert spark.read.text(big).rdd.getNumPartitions() > 5
        got = df.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("consumption_wh").alias("c")).collect()
        assert sorted(tuple(r) for r in got) == [("big", 20_000, sum(range(20_000)) * 1.0), ("small", 1, 5.0)]
        with pytest.raises(Exception, match="was split"):
            stream = readings_stream(spark, str(tmp_path), "big.csv").writeStream.format("memory").queryName("split_file")
            stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_names_in_two_folders_and_null_dates_lose_nothing(spark, tmp_path):
    for folder, value in (("x", 1), ("y", 2)):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "S.csv", HEADER, f"01.01.2023,{value},1,1,1,1", f"bad,{value},1,1,1,1", f"worse,{value},1,1,1,1")
    assert read_readings(spark, str(tmp_path / "*" / "S.csv")).count() == 6


def test_nothing_to_read(spark):
    assert read_readings(spark, "/no/such/*.csv").count() == 0
    assert read_store(spark, "/no/such/store") is None


def test_names_from_paths(spark):
    paths = ["file:/a/b%20c/datos_energia_X%20Y.csv", "/a/datos_Z+1.csv", "/a/24_02_AL_BA_01022024-01022025.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(R.source_name("path").alias("s"))
    rows = df.select("s", R.site_name("s").alias("site")).collect()
    assert [r.s for r in rows] == ["X Y", "Z+1", "24_02_AL_BA_01022024-01022025"]
    assert rows[2].site == "AL_BA"


def test_numbers_and_dates_that_only_look_right(spark):
    cells = ["1.5", " 2 ", "-3e2", "1d", "2.f", "0x1p3", "NaN", "", "1,5", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", R.to_number("c").alias("v")).orderBy("i").collect()]
    assert got == [1.5, 2.0, -300.0, None, None, None, None, None, None, None]
    dates = ["01.02.2023", "1.2.2023", "31.02.2023", "2023-02-01", "2023-02-01 10:30:00", "x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(dates)], "i int, c string")
    rows = df.select("i", R.to_date("c").alias("v"), R.to_date_strict("c").alias("s")).orderBy("i").collect()
    day = dt.date(2023, 2, 1)
    assert [r.v for r in rows] == [day, day, None, day, day, None, None]
    assert [r.s for r in rows] == [day, day, None, None, None, None, None]


def test_features(spark):
    df = spark.createDataFrame([("s", dt.date(2023, 1, 1), 10.0, 0.0)], "source_id string, reading_date date, generation_wh double, consumption_wh double")
    out = R.with_features(df)
    row = out.first()
    assert (row.day, row.month, row.weekday, row.is_weekend) == (1, 1, 6, 1)
    assert row.generation_consumption_ratio == pytest.approx(1e7)
    assert "grid_balance" not in out.columns and "self_consumption_efficiency" not in out.columns
    assert R.feature_names(out)[0] == "generation_wh" and len(R.feature_names(out)) == 8


def test_written_files_read_back(spark, files, tmp_path):
    df = read_readings(spark, files).where("reading_date is not null")
    tables.write_units_csv(df, str(tmp_path / "out"))
    back = read_readings(spark, str(tmp_path / "out" / "*" / "*.csv")).select("source_id", "site_id", "reading_date", *S.MEASURES)
    assert back.exceptAll(df.select(back.columns)).count() == 0 and back.count() == df.count()


def test_a_large_source_is_written_as_several_files(spark, tmp_path):
    values = [F.col("id").cast("double").alias(m) for m in S.MEASURES]
    df = spark.range(500).select((F.col("id") % 100 == 0).cast("string").alias("source_id"), F.lit(dt.date(2023, 1, 1)).alias("reading_date"), *values)
    tables.write_units_csv(df, str(tmp_path / "out"), file_rows=40)
    written = list((tmp_path / "out" / "source=false").glob("*.csv"))
    assert len(written) > 4
    assert max(len(f.read_text().splitlines()) for f in written) < 200
    assert all(f.read_text().splitlines()[1].startswith("[dd") for f in written)
    back = read_readings(spark, str(tmp_path / "out" / "*" / "*.csv")).select(*df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == 500


def test_lines_cut_at_once_equal_lines_cut_one_by_one():
    even = ["[dd.MM.yyyy],[Wh]", "1,2,,4", ",,,", "é, b ,c,d", "[x,1,2,3"]
    odd = ["1,2", "", " \t", 'a,"b,c",d', "1,2,3,4,5", "x", ",", "\x1c"]
    header = [0, None, 3, 1, 9, None, None, None]
    for lines in (even, odd, even + odd, [], ["5", " "]):
        rows = [sources._cells(x) for x in lines if x.strip() and not x.startswith("[")]
        want = [[None if i is None or i >= len(r) else r[i] or None for r in rows] for i in header]
        assert [c.to_pylist() for c in sources._named(sources.pa.array(lines, "string"), header)] == want


def test_history_array_and_retention(spark, tmp_path):
    path = write(
        tmp_path, "history.json",
        '[{"timestamp": "2024-01-01T10:00:00.5", "empresa": "A", "datos": {"Generación total": 5, "Consumo total": 6, "Autoconsumo": 4}, "es_anomalia": false, "score": -0.4},',
        ' {"timestamp": "not a time", "empresa": null, "datos": {"Generación total": 5}, "es_anomalia": true, "score": null}]',
    )
    rows = {r.site_id: r for r in history_readings(read_history_json(spark, path)).collect()}
    assert rows["A"].reading_ts == dt.datetime(2024, 1, 1, 10, 0, 0, 500000) and rows["A"].self_consumption_wh == 4.0
    assert rows["Desconocida"].reading_ts is None and rows["Desconocida"].score == 0.0
    store = str(tmp_path / "store")
    records = spark.range(2500).select(F.col("id").alias("ts"), (F.col("id") % 2).alias("site"))
    tables.append(records, store)
    kept = tables.retained(spark.read.parquet(store), ["ts"])
    assert (kept.count(), kept.agg(F.min("ts")).first()[0]) == (1000, 1500)
    assert tables.retained(spark.read.parquet(store), ["ts"], 10, by=["site"]).count() == 20


def test_replayed_batch_stores_alerts_once(spark, tmp_path):
    alerts = spark.createDataFrame([("A", "CRÍTICA"), ("B", "ALTA")], "empresa string, severidad string")
    for _ in range(2):
        tables.fan_out_alerts(alerts, str(tmp_path / "all"), str(tmp_path / "critical"), "r3")
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert [r.empresa for r in spark.read.parquet(str(tmp_path / "critical")).collect()] == ["A"]


def test_reload_union_and_confusion(spark):
    a = spark.createDataFrame([("s", 1, 2.0), ("s", 1, 2.0), ("s", 2, 1.0)], "source_id string, reading_date int, x double")
    assert sets.drop_reloaded(a).count() == 2
    nulls = spark.createDataFrame([("s", None, 1.0), ("s", None, 1.0), ("s", 3, 1.0), ("s", 3, 2.0)], a.schema)
    assert sets.drop_reloaded(nulls).count() == 4
    assert sets.union_sites([a, a.drop("x")]).count() == 6
    empty = a.limit(0)
    row = sets.confusion(empty, empty, ["source_id", "reading_date"]).first()
    assert (row.precision, row.recall, row.f1_score) == (0.0, 0.0, 0.0)
    row = sets.confusion(a.where("reading_date = 1"), a, ["source_id", "reading_date"]).first()
    assert (row.true_positives, row.false_positives, row.false_negatives) == (1, 0, 1)
    assert row.f1_score == pytest.approx(2 / 3)


def test_reports_on_no_rows(spark):
    none = spark.createDataFrame([], "source_id string, is_anomaly boolean, score double, generation_wh double, consumption_wh double")
    assert reports.global_summary(none).first().anomaly_percent == 0.0
    assert reports.validation_stats(none).first().asDict() == {
        "total_samples": 0, "anomalies_detected": 0, "anomaly_rate": 0.0, "mean_anomaly_score": 0.0,
    }


def test_many_sites_share_files(spark, tmp_path):
    rows = helpers.random_sites(spark, sites=60, days=20)
    rows = rows.unionByName(rows.limit(1).withColumns({"site_id": F.lit("x,y"), "source_id": F.lit("x,y")}))
    tables.write_site_files(rows, str(tmp_path / "out"), "site_id", file_rows=200)
    assert len(list((tmp_path / "out").glob("*.csv"))) <= 7
    back = read_readings(spark, str(tmp_path / "out"))
    assert [r[0] for r in back.groupBy("site_id").agg(F.count_distinct("source_id")).select(F.col("count(DISTINCT source_id)")).distinct().collect()] == [1]
    back = back.select("site_id", "reading_date", *S.MEASURES)
    assert back.count() == rows.count() and back.exceptAll(rows.select(back.columns)).isEmpty()
    for file in (tmp_path / "out").glob("*.csv"):
        assert file.read_text().splitlines()[1].startswith("[dd.MM.yyyy]")


def test_packed_site_files_hold_whole_sites_by_date(spark, tmp_path):
    rows = helpers.random_sites(spark, sites=20, days=30)
    tables.write_site_files(rows, str(tmp_path / "out"), "site_id", 100, "gzip")
    files = sorted((tmp_path / "out").glob("*.csv.gz"))
    texts = [gzip.decompress(f.read_bytes()).decode().splitlines() for f in files]
    assert 1 < len(files) <= 6 and all(t[1].startswith("[dd.MM.yyyy]") for t in texts)
    sites = [[line.rsplit(",", 1)[1] for line in t[2:]] for t in texts]
    assert all(s == sorted(s) for s in sites) and sum(len(set(s)) for s in sites) == 20
    back = read_readings(spark, str(tmp_path / "out")).select("site_id", "reading_date", *S.MEASURES)
    assert back.count() == rows.count() and back.exceptAll(rows.select(back.columns)).isEmpty()
