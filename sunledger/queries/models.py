"""Training, scoring, tuning and the streaming jobs that use a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.operators.forest import NODE_SCHEMA, score_forest
from sunledger.operators.scaling import fit_scaler
from sunledger.plans import jobs, tuning
from sunledger.plans.model import AnomalyModel, train
from sunledger.queries import views as V
from sunledger.queries.prediction import P21_SQL, flat_problem_alerts
from sunledger.queries.registry import query
from sunledger.sinks import tables
from sunledger.storage import materialize, scratch_path
from sunledger.streaming.folder import monitor_folder, readings_stream
from sunledger.streaming.trends import stream_problems

KEY = ["source_id", "reading_date"]
#: Readings in a compressed file of several sources, about.
PACKED_ROWS = 50_000


def _stored(spark, sf):
    return materialize(V.stressed(spark, sf), "readings")


def _files(spark, sf, name, df=None):
    """The readings as files of several sites each; returns their folder."""
    path = scratch_path(spark, name)
    tables.write_site_files(V.stressed(spark, sf) if df is None else df, path, "site_id")
    return path


# A small forest of two trees, written by hand, so that SQL can compute its scores.
FIXED_NODES = [
    (0, 0, 0, None, 30000.0, 1, 2, 256),
    (0, 1, 1, None, 8000.0, 3, 4, 120),
    (0, 2, -1, None, None, None, None, 136),
    (0, 3, -1, None, None, None, None, 1),
    (0, 4, -1, None, None, None, None, 119),
    (1, 0, 1, None, 52000.0, 1, 2, 256),
    (1, 1, -1, None, None, None, None, 128),
    (1, 2, -1, None, None, None, None, 128),
]
_C = "(2.0 * (ln({n} - 1.0) + 0.5772156649) - 2.0 * ({n} - 1.0) / {n})"


@query(
    "M02_fixed_forest_score",
    f"""WITH {V.STRESSED}, depths AS (SELECT source_id, {V.DATE},
      CASE WHEN generation_wh < 30000 THEN CASE WHEN consumption_wh < 8000 THEN 2.0 ELSE 2.0 + {_C.format(n='119.0')} END ELSE 1.0 + {_C.format(n='136.0')} END AS a,
      1.0 + {_C.format(n='128.0')} AS b FROM stressed)
    SELECT source_id, {V.DATE}, {V.r(f"-pow(2.0, -((a + b) / 2.0) / {_C.format(n='256.0')})", 'score')} FROM depths""",
)
def m02_fixed(spark, sf):
    nodes = spark.createDataFrame(FIXED_NODES, NODE_SCHEMA)
    scored = score_forest(V.stressed(spark, sf), nodes, ["generation_wh", "consumption_wh"], 256)
    return V.rounded(scored.select("source_id", "reading_date", "score"), ["score"])


# The fixed forest as a model: features as they are, thresholds given.
_MEASURED = ["generation_wh", "consumption_wh"]
_THRESHOLD, _SEVERITY_CUT = -0.51, -0.6
FIXED_SCORED = f"""{V.STRESSED}, depths AS (SELECT *, CASE WHEN generation_wh < 30000 THEN
      CASE WHEN consumption_wh < 8000 THEN 2.0 ELSE 2.0 + {_C.format(n='119.0')} END ELSE 1.0 + {_C.format(n='136.0')} END AS a,
      1.0 + {_C.format(n='128.0')} AS b FROM stressed),
    scored AS (SELECT * EXCLUDE (a, b), -pow(2.0, -((a + b) / 2.0) / {_C.format(n='256.0')}) AS score, score < {_THRESHOLD} AS is_anomaly FROM depths)"""


def _fixed_model(spark, nodes=FIXED_NODES, scaler=None):
    if scaler is None:
        row = {f"{c}__{part}": value for c in _MEASURED for part, value in (("center", 0.0), ("scale", 1.0))}
        scaler = spark.createDataFrame([row], ", ".join(f"{c} double" for c in row))
    params = {
        "features": _MEASURED, "normalization": "global", "legacy_order": False, "site_aware": False, "n_trees": 2, "psi": 256, "seed": 42,
        "rows": 256, "trained_date": "2024-01-01T00:00:00+00:00", "contamination": 0.1, "threshold": _THRESHOLD, "severity_cut": _SEVERITY_CUT,
    }
    return AnomalyModel(spark.createDataFrame(nodes, NODE_SCHEMA), scaler, scaler, params)


_SCORE = V.r("score", "score")
_ALERT_SQL = f"""SELECT strftime(reading_date, '%d.%m.%Y') AS fecha_dato, {{site}} AS empresa, is_anomaly AS es_anomalia, {_SCORE},
    CASE WHEN score < -0.5 THEN 'CRÍTICA' WHEN score < -0.3 THEN 'ALTA' WHEN score < -0.1 THEN 'MEDIA' ELSE 'BAJA' END AS severidad,
    generation_wh AS generacion FROM scored WHERE is_anomaly"""


def _alerts(df):
    flat = df.withColumn("generacion", F.col("datos").getField("Generación total"))
    return V.rounded(flat.select("fecha_dato", "empresa", "es_anomalia", "score", "severidad", "generacion"), ["score"])


@query(
    "M01_train_forest",
    f"""WITH {V.STRESSED} SELECT CAST(tree AS INTEGER) AS tree, least(256, (SELECT count(*) FROM stressed)) AS leaf_rows, true AS bounded
    FROM (SELECT unnest(range(0, 100)) AS tree)""",
)
def m01(spark, sf):
    """Each tree's leaves hold its sample; no tree has more nodes than a tree of height eight."""
    nodes = train(_stored(spark, sf)).nodes
    leaf_rows = F.sum(F.when(F.col("feature") == -1, F.col("rows")))
    return nodes.groupBy("tree").agg(leaf_rows.alias("leaf_rows"), (F.count(F.lit(1)) <= 511).alias("bounded"))


@query("M02_forest_score", f"WITH {V.STRESSED} SELECT source_id, {V.DATE}, true AS in_range FROM stressed")
def m02(spark, sf):
    readings = _stored(spark, sf)
    score = F.col("score")
    return train(readings).score(readings).select(*KEY, ((score < 0) & (score >= -1)).alias("in_range"))


@query(
    "M02_planted_outages",
    f"""WITH {V.STRESSED}, kinds AS (SELECT CASE WHEN (CAST(site_id AS INTEGER) + day(reading_date)) % 11 = 0 THEN 'outage' ELSE 'normal' END AS kind FROM stressed)
    SELECT kind, count(*) AS readings, kind = 'outage' AS below_all FROM kinds GROUP BY kind""",
)
def m02_planted(spark, sf):
    """Days without generation score lower than the rest: a forest that does not tell them apart fails."""
    readings = _stored(spark, sf)
    phase = (F.col("site_id").cast("int") + F.dayofmonth("reading_date")) % 11
    scored = materialize(train(readings).score(readings).select(F.when(phase == 0, "outage").otherwise("normal").alias("kind"), "score"), "m02-kinds")
    every = scored.agg(F.avg("score").alias("mean"))
    kinds = scored.groupBy("kind").agg(F.count(F.lit(1)).alias("readings"), F.avg("score").alias("own"))
    return kinds.join(F.broadcast(every)).select("kind", "readings", (F.col("own") < F.col("mean") - 0.01).alias("below_all"))


_PROFILE = f"""count(*) AS records, {V.r('avg(generation_wh)', 'mean_generation', 4)}, {V.r('avg(consumption_wh)', 'mean_consumption', 4)},
    {V.r('stddev_samp(generation_wh)', 'std_generation', 4)}, {V.r('stddev_samp(consumption_wh)', 'std_consumption', 4)}"""
_PROFILE_COLUMNS = ["mean_generation", "mean_consumption", "std_generation", "std_consumption"]


@query("M05_train_multi_site", f"WITH {V.STRESSED} SELECT site_id AS source_id, {_PROFILE} FROM stressed GROUP BY site_id")
def m05(spark, sf):
    model = jobs.train_from_files(spark, [_files(spark, sf, "m05")], save_to=scratch_path(spark, "m05-model"))
    return V.rounded(model.profiles.drop("file"), _PROFILE_COLUMNS, 4)


_GRID_SQL = """SELECT c AS contamination, CAST(t AS INTEGER) AS n_estimators, true AS in_range
    FROM (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS c), (SELECT unnest([50, 100, 200]) AS t)"""


def _grid_in_range(grid):
    fits = F.col("mean_score").between(-1, 0) & F.col("anomaly_rate").between(0, 1) & (F.col("num_anomalies") >= 0)
    return grid.select("contamination", "n_estimators", fits.alias("in_range"))


@query("M06_grid_search", _GRID_SQL)
def m06(spark, sf):
    return _grid_in_range(tuning.grid_search(_stored(spark, sf)))


@query("K07_grid_results_csv", _GRID_SQL)
def k07(spark, sf):
    path = scratch_path(spark, "k07")
    grid = tuning.grid_search(_stored(spark, sf))
    tables.write_csv(grid, path)
    return _grid_in_range(spark.read.schema(grid.schema).option("header", True).csv(path))


@query("M07_train_with_validation", f"WITH {V.STRESSED} SELECT count(*) - CAST(floor(count(*) * 0.8 + 1e-9) AS BIGINT) AS total_samples, true AS in_range FROM stressed")
def m07(spark, sf):
    stats = tuning.train_with_validation(_stored(spark, sf))[1]
    fits = F.col("anomaly_rate").between(0, 1) & F.col("mean_anomaly_score").between(-1, 0) & (F.col("anomalies_detected") <= F.col("total_samples"))
    return stats.select("total_samples", fits.alias("in_range"))


@query("M08_stored_model", f"WITH {FIXED_SCORED} SELECT source_id, {V.DATE}, {_SCORE}, is_anomaly FROM scored")
def m08(spark, sf):
    path = scratch_path(spark, "m08")
    _fixed_model(spark).save(path)
    return V.rounded(AnomalyModel.load(spark, path).predict(V.stressed(spark, sf)).select(*KEY, "score", "is_anomaly"), ["score"])


@query("M09_retrain", f"WITH {V.STRESSED} SELECT source_id, {_PROFILE} FROM stressed GROUP BY source_id")
def m09(spark, sf):
    readings, path = _stored(spark, sf), scratch_path(spark, "m09")
    tables.append(readings.where(F.year("reading_date") < 1995), path)
    model = tuning.retrain(path, readings.where(F.year("reading_date") >= 1995), _fixed_model(spark))
    return V.rounded(model.profiles, _PROFILE_COLUMNS, 4)


# The same two trees with cuts on z-scores.
_Z_NODES = [(*n[:4], {30000.0: -0.5, 8000.0: -1.0, 52000.0: 0.5}.get(n[4], n[4]), *n[5:]) for n in FIXED_NODES]


@query(
    "M10_site_aware_score",
    f"""WITH {V.STRESSED}, m AS (SELECT source_id, avg(generation_wh) AS mg, stddev_pop(generation_wh) AS sg, avg(consumption_wh) AS mc,
      stddev_pop(consumption_wh) AS sc FROM stressed GROUP BY source_id),
    z AS (SELECT source_id, reading_date, (generation_wh - mg) / CASE sg WHEN 0 THEN 1 ELSE sg END AS g,
      (consumption_wh - mc) / CASE sc WHEN 0 THEN 1 ELSE sc END AS c FROM stressed JOIN m USING (source_id)),
    d AS (SELECT *, CASE WHEN g < -0.5 THEN CASE WHEN c < -1.0 THEN 2.0 ELSE 2.0 + {_C.format(n='119.0')} END ELSE 1.0 + {_C.format(n='136.0')} END AS a,
      1.0 + {_C.format(n='128.0')} AS b FROM z), s AS (SELECT *, -pow(2.0, -((a + b) / 2.0) / {_C.format(n='256.0')}) AS score FROM d)
    SELECT source_id, {V.DATE}, {_SCORE}, score < {_THRESHOLD} AS is_anomaly FROM s""",
)
def m10(spark, sf):
    readings = _stored(spark, sf)
    model = _fixed_model(spark, _Z_NODES, fit_scaler(readings, _MEASURED, "per_company"))
    return V.rounded(model.predict(readings).select(*KEY, "score", "is_anomaly"), ["score"])


_BATCH_SEVERITY = "CASE WHEN score <= (SELECT quantile_cont(score, 0.1) FROM scored) THEN 'Alta' ELSE 'Normal' END AS severity"


@query("M12_score_table", f"WITH {FIXED_SCORED} SELECT source_id, {V.DATE}, {_SCORE}, is_anomaly, {_BATCH_SEVERITY} FROM scored")
def m12(spark, sf):
    scored = jobs.score_table(_fixed_model(spark), V.stressed(spark, sf))
    return V.rounded(scored.select(*KEY, "score", "is_anomaly", "severity"), ["score"])


@query(
    "M13_score_files",
    f"""WITH {FIXED_SCORED} SELECT 'NEUROCENTRO' AS source_id, site_id, {V.DATE}, {', '.join(S.MEASURES)}, {_SCORE}, is_anomaly, {_BATCH_SEVERITY}
    FROM scored""",
)
def m13(spark, sf):
    scored, _, _ = jobs.score_files(spark, _fixed_model(spark), _files(spark, sf, "m13"), scratch_path(spark, "m13-out"), "NEUROCENTRO")
    return V.rounded(scored, ["score"])


@query("M14_alert_files", f"WITH {FIXED_SCORED} {_ALERT_SQL.format(site='site_id')}")
def m14(spark, sf):
    """Two runs, the second of them repeated: the store holds both, once."""
    model, root, df = _fixed_model(spark), scratch_path(spark, "m14"), _stored(spark, sf)
    early = F.year("reading_date") < 1995
    runs = {"early": _files(spark, sf, "m14-a", df.where(early)), "late": _files(spark, sf, "m14-b", df.where(~early))}
    for run_id in ("early", "late", "late"):
        jobs.alert_files(spark, model, runs[run_id], f"{root}/alerts", f"{root}/critical", run_id)
    return _alerts(spark.read.parquet(f"{root}/alerts"))


_M15_SQL = P21_SQL.replace(V.STRESSED_SCORED, FIXED_SCORED).replace("score, risk_score", f"{_SCORE}, risk_score")


@query("M15_problem_report", _M15_SQL)
def m15(spark, sf):
    return V.rounded(flat_problem_alerts(jobs.problem_report(_fixed_model(spark), _stored(spark, sf))[0]), ["score"])


@query("M15_problem_files", _M15_SQL)
def m15_files(spark, sf):
    """Three runs, each with the history that the earlier ones stored, equal one run over everything."""
    model, root, df = _fixed_model(spark), scratch_path(spark, "m15"), V.stressed(spark, sf)
    year = F.year("reading_date")
    for name, part in (("a", year < 1994), ("b", (year >= 1994) & (year < 1996)), ("c", year >= 1996)):
        files = scratch_path(spark, f"m15-{name}")
        tables.write_site_files(df.where(part), files, "site_id", PACKED_ROWS, "gzip")
        jobs.problem_files(spark, model, files, f"{root}/history", f"{root}/alerts", f"{root}/critical", name)
    return V.rounded(flat_problem_alerts(spark.read.parquet(f"{root}/alerts")), ["score"])


@query(
    "A15_compare_normalizations",
    "SELECT unnest(['global', 'per_company', 'robust']) AS method, true AS in_range",
)
def a15(spark, sf):
    """The threshold is the tenth percentile of the scores, so a tenth of the rows, and one more at most, lies below it."""
    found = tuning.compare_normalizations(_stored(spark, sf))
    return found.select("method", (F.col("percentage").between(0, 10.1) & (F.col("anomalies") >= 0)).alias("in_range"))


# --- Streams ---------------------------------------------------------------------------------


def _drain(stream, root):
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


_STREAM_SQL = f"SELECT {V.DATE}, {', '.join(S.MEASURES)} FROM stressed"


@query("T01_folder_stream", f"WITH {V.STRESSED} {_STREAM_SQL}")
def t01(spark, sf):
    """Files of two layouts in one folder: the second has other columns among the known ones, in another order."""
    root, folder = scratch_path(spark, "t01"), scratch_path(spark, "t01-in")
    df, half = _stored(spark, sf), F.col("site_id").cast("int") % 2 == 0
    tables.write_site_files(df.where(half), f"{folder}/plain", "site_id")
    named = tables.with_source_headers(df.where(~half).select("reading_date", *S.MEASURES))
    order = [F.lit("x").alias("Otra"), *[F.col(c) for c in reversed(named.columns)]]
    tables.write_csv(named.select(*order).withColumnRenamed(S.DATE_HEADERS[0], S.DATE_HEADERS[1]), f"{folder}/other")
    _drain(readings_stream(spark, folder), root)
    return spark.read.parquet(f"{root}/out").select("reading_date", *S.MEASURES)


@query("T02_processed_files", f"WITH {V.STRESSED} {_STREAM_SQL}")
def t02(spark, sf):
    """Two runs over one checkpoint: files of the first are not read again by the second."""
    root, folder = scratch_path(spark, "t02"), scratch_path(spark, "t02-in")
    df = _stored(spark, sf)
    for part in (F.year("reading_date") < 1999, F.year("reading_date") >= 1999):
        rows = tables.with_source_headers(df.where(part).select("reading_date", *S.MEASURES))
        rows.write.mode("append").option("header", True).csv(folder)
        _drain(readings_stream(spark, folder), root)
    return spark.read.parquet(f"{root}/out").select("reading_date", *S.MEASURES)


@query("T03_stream_alerts", f"WITH {FIXED_SCORED} {_ALERT_SQL.format(site='site_id')}")
def t03(spark, sf):
    root, folder = scratch_path(spark, "t03"), _files(spark, sf, "t03-in")
    monitor_folder(readings_stream(spark, folder, max_files=400), _fixed_model(spark), f"{root}/alerts", f"{root}/critical", f"{root}/checkpoint", once=True).awaitTermination()
    return _alerts(spark.read.parquet(f"{root}/alerts"))


@query(
    "T05_arriving_readings",
    f"""WITH {FIXED_SCORED} SELECT site_id AS source_id, site_id, {V.DATE}, {', '.join(S.MEASURES)}, {_SCORE}, is_anomaly,
    CASE WHEN score <= {_SEVERITY_CUT} THEN 'Alta' ELSE 'Normal' END AS severity FROM scored""",
)
def t05(spark, sf):
    """Readings scored as they arrive, their severity from the training scores."""
    root, folder = scratch_path(spark, "t05"), _files(spark, sf, "t05-in")
    _drain(_fixed_model(spark).get_anomalies(readings_stream(spark, folder), severity_from="training"), root)
    return V.rounded(spark.read.parquet(f"{root}/out"), ["score"])


@query("T05_problems_on_arrival", _M15_SQL)
def t05_problems(spark, sf):
    """Three arrivals of files, each scored, analysed with what is remembered of its sites, and alerted on."""
    root, folder, df = scratch_path(spark, "t05p"), scratch_path(spark, "t05p-in"), V.stressed(spark, sf)
    model, year = _fixed_model(spark), F.year("reading_date")
    for name, part in (("a", year < 1994), ("b", (year >= 1994) & (year < 1996)), ("c", year >= 1996)):
        tables.write_site_files(df.where(part), f"{folder}/{name}", "site_id", PACKED_ROWS, "gzip")
        where = [f"{root}/{store}" for store in ("history", "alerts", "critical", "late", "checkpoint")]
        stream_problems(readings_stream(spark, folder, "*.csv.gz"), model, *where, once=True).awaitTermination()
    return V.rounded(flat_problem_alerts(spark.read.parquet(f"{root}/alerts")), ["score"])
