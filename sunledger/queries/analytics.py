"""Aggregates, normalisation, limits and report tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions import severity as sev
from sunledger.functions.readings import with_features
from sunledger.operators import alerts as A
from sunledger.operators import order_statistics as O
from sunledger.operators import reports, scaling
from sunledger.plans import tuning
from sunledger.plans.jobs import fleet_report
from sunledger.plans.model import add_batch_severity, decide
from sunledger.queries import views as V
from sunledger.queries.ingest import PROFILES_SQL, _PROFILE_COLUMNS
from sunledger.queries.registry import ORACLES, query
from sunledger.storage import materialize

# --- Aggregates ------------------------------------------------------------------------------


@query(
    "A01_rows_per_site",
    f"""WITH {V.READINGS} SELECT source_id, count(*) AS records, {V.r('count(*) * 100.0 / sum(count(*)) OVER ()', 'share_percent')}
    FROM readings GROUP BY source_id""",
)
def a01(spark, sf):
    return V.rounded(reports.rows_per_site(V.readings(spark, sf)), ["share_percent"])


@query("A02_site_profile", PROFILES_SQL)
def a02(spark, sf):
    return V.rounded(reports.site_profiles(V.readings(spark, sf)), _PROFILE_COLUMNS, 4)


@query(
    "A03_anomaly_rate",
    f"WITH {V.SCORED} SELECT site_id, {V.r('avg(CAST(is_anomaly AS INTEGER)) * 100', 'anomaly_rate')} FROM scored GROUP BY site_id",
)
def a03(spark, sf):
    report = reports.site_report(V.scored(spark, sf), "site_id").select("site_id", "anomaly_rate")
    return V.rounded(report, ["anomaly_rate"])


@query("A04_anomaly_count", f"WITH {V.SCORED} SELECT site_id, count(*) AS anomalies FROM scored WHERE is_anomaly GROUP BY site_id")
def a04(spark, sf):
    return reports.anomalies_per_site(V.scored(spark, sf), "site_id")


_RATE = "avg(CAST(is_anomaly AS INTEGER)) * 100"
_BAND_OF_RATE = "CASE WHEN anomaly_rate > 5 THEN 'red' WHEN anomaly_rate > 2 THEN 'orange' ELSE 'green' END"
_BAND = f"CASE WHEN {_RATE} > 5 THEN 'red' WHEN {_RATE} > 2 THEN 'orange' ELSE 'green' END AS rate_band"
_REPORT = f"""SELECT site_id, count(*) AS records, count(*) FILTER (is_anomaly) AS anomalies, {V.r(_RATE, 'anomaly_rate')}, {_BAND},
    {V.r('avg(score)', 'mean_score')}, {V.r('avg(generation_wh)', 'mean_generation', 4)}, {V.r('avg(consumption_wh)', 'mean_consumption', 4)}
    FROM scored GROUP BY site_id"""


def _report(spark, sf):
    report = V.rounded(reports.site_report(V.scored(spark, sf), "site_id"), ["anomaly_rate", "mean_score"])
    return V.rounded(report, ["mean_generation", "mean_consumption"], 4)


query("A05_site_report", f"WITH {V.SCORED} {_REPORT}")(_report)


@query("P29_rate_band", f"WITH {V.SCORED} SELECT source_id, {_BAND} FROM scored GROUP BY source_id")
def p29(spark, sf):
    return reports.site_report(V.scored(spark, sf)).select("source_id", "rate_band")


@query(
    "A06_global_summary",
    f"""WITH {V.SCORED} SELECT count(*) AS total, count(*) FILTER (NOT is_anomaly) AS normal, count(*) FILTER (is_anomaly) AS anomalies,
    {V.r(_RATE, 'anomaly_percent')} FROM scored""",
)
def a06(spark, sf):
    return V.rounded(reports.global_summary(V.scored(spark, sf)), ["anomaly_percent"])


_EXECUTIVE = f"""s AS (SELECT site_id, count(*) AS n, count(*) FILTER (is_anomaly) AS a FROM scored GROUP BY site_id)
    SELECT count(*) AS sites, CAST(sum(n) AS BIGINT) AS records, CAST(sum(a) AS BIGINT) AS anomalies, {V.r('sum(a) * 100.0 / sum(n)', 'anomaly_rate')},
      (SELECT site_id FROM s ORDER BY n DESC, site_id LIMIT 1) AS largest_site, (SELECT n FROM s ORDER BY n DESC, site_id LIMIT 1) AS largest_site_records,
      (SELECT site_id FROM s ORDER BY a DESC, site_id LIMIT 1) AS worst_site, (SELECT a FROM s ORDER BY a DESC, site_id LIMIT 1) AS worst_site_anomalies
    FROM s"""


@query("A07_executive_summary", f"WITH {V.SCORED}, {_EXECUTIVE}")
def a07(spark, sf):
    return V.rounded(reports.executive_summary(V.scored(spark, sf), "site_id"), ["anomaly_rate"])


_AS_OF = "TIMESTAMP '2024-01-28 12:00:00'"


@query(
    "A08_alert_summary",
    f"""WITH {V.ALERTS}, recent AS (SELECT * FROM alerts WHERE "timestamp" > {_AS_OF} - INTERVAL 7 DAY)
    SELECT 'total' AS dimension, NULL AS key, count(*) AS alerts FROM recent
    UNION ALL SELECT 'last_24h', NULL, count(*) FILTER ("timestamp" > {_AS_OF} - INTERVAL 1 DAY) FROM recent
    UNION ALL SELECT 'severity', severidad, count(*) FROM recent GROUP BY severidad
    UNION ALL SELECT 'site', empresa, count(*) FROM recent GROUP BY empresa""",
)
def a08(spark, sf):
    return A.alert_summary(V.alerts(spark, sf), F.lit("2024-01-28 12:00:00").cast("timestamp"), 7)


@query(
    "A09_validation_stats",
    f"""WITH {V.SCORED} SELECT count(*) AS total_samples, count(*) FILTER (is_anomaly) AS anomalies_detected,
    {V.r('avg(CAST(is_anomaly AS INTEGER))', 'anomaly_rate')}, {V.r('COALESCE(avg(score) FILTER (is_anomaly), 0)', 'mean_anomaly_score')} FROM scored""",
)
def a09(spark, sf):
    return V.rounded(reports.validation_stats(V.scored(spark, sf)), ["anomaly_rate", "mean_anomaly_score"])


_PROBS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9]


@query(
    "A11_percentile",
    f"WITH {V.SCORED} "
    + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prob, {V.r(f'quantile_cont(score, {p})', 'value')} FROM scored" for p in _PROBS
    ),
)
def a11(spark, sf):
    rows = O.exact_percentiles(materialize(V.scored(spark, sf).select("score"), "scores"), ["score"], _PROBS)
    return V.rounded(rows.select("prob", "value"), ["value"])


@query(
    "A12_score_histogram",
    f"""WITH {V.SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
    f AS (SELECT score, lo, (hi - lo) / 50 AS w, least(floor((score - lo) / (hi - lo) * 50), 49) AS i FROM scored, e),
    b AS (SELECT CAST(CASE WHEN score < lo + i * w THEN i WHEN score >= lo + (i + 1) * w AND i < 49 THEN i + 2 ELSE i + 1 END AS INTEGER) AS bin,
      count(*) AS n FROM f GROUP BY ALL),
    every AS (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin)
    SELECT bin, {V.r('lo + (bin - 1) * ((hi - lo) / 50)', 'lower', 4)}, {V.r('lo + bin * ((hi - lo) / 50)', 'upper', 4)}, coalesce(n, 0) AS rows
    FROM every CROSS JOIN e LEFT JOIN b USING (bin)""",
)
def a12(spark, sf):
    return V.rounded(O.histogram(V.scored(spark, sf), "score"), ["lower", "upper"], 4)


_BOX = f"""top AS (SELECT site_id FROM scored GROUP BY site_id ORDER BY count(*) DESC, site_id LIMIT 10),
    kept AS (SELECT * FROM scored WHERE site_id IN (SELECT site_id FROM top)),
    q AS (SELECT site_id, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM kept GROUP BY site_id)
    SELECT site_id, {V.r('q1', 'q1')}, {V.r('median', 'median')}, {V.r('q3', 'q3')},
      {V.r('min(score) FILTER (score >= q1 - 1.5 * (q3 - q1))', 'lower_whisker')}, {V.r('max(score) FILTER (score <= q3 + 1.5 * (q3 - q1))', 'upper_whisker')},
      count(*) FILTER (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM kept JOIN q USING (site_id) GROUP BY site_id, q1, median, q3"""


@query("A13_box_plots", f"WITH {V.STRESSED_SCORED}, {_BOX}")
def a13(spark, sf):
    boxes = reports.box_plots(materialize(V.stressed_scored(spark, sf).select("site_id", "score"), "scores"), 10, "site_id")
    return V.rounded(boxes, ["q1", "median", "q3", "lower_whisker", "upper_whisker"])


@query("A14_threshold_marker", f"WITH {V.SCORED} SELECT {V.r('min(score) FILTER (is_anomaly)', 'threshold_marker')} FROM scored")
def a14(spark, sf):
    return V.rounded(reports.anomaly_threshold_marker(V.scored(spark, sf)), ["threshold_marker"])


# --- Percentile severity and decision given scores -------------------------------------------

_SEVERITY = """CASE WHEN score <= (SELECT quantile_cont(score, 0.1) FROM scored) THEN 'Alta' ELSE 'Normal' END AS severity"""


@query("P19_batch_severity", f"WITH {V.SCORED} SELECT source_id, {V.DATE}, {_SEVERITY} FROM scored")
def p19(spark, sf):
    scores = materialize(V.scored(spark, sf).select("source_id", "reading_date", "score"), "scores")
    return add_batch_severity(scores).select("source_id", "reading_date", "severity")


@query(
    "M03_decide_anomaly",
    f"WITH {V.SCORED} SELECT source_id, {V.DATE}, score < (SELECT quantile_cont(score, 0.15) FROM scored) AS is_anomaly FROM scored",
)
def m03(spark, sf):
    df = materialize(V.scored(spark, sf).select("source_id", "reading_date", "score"), "scores")
    cut = O.percentile_row(df, "score", {"threshold": 0.15})
    return O.with_scalar(df, cut).select("source_id", "reading_date", decide(F.col("score"), F.col("threshold")).alias("is_anomaly"))


@query(
    "M04_attach_results",
    f"""WITH {V.SCORED} SELECT source_id, {V.DATE}, generation_wh, score,
    score < (SELECT quantile_cont(score, 0.15) FROM scored) AS is_anomaly, {_SEVERITY} FROM scored""",
)
def m04(spark, sf):
    df = materialize(V.scored(spark, sf).drop("is_anomaly"), "scored")
    decided = O.with_scalar(df, O.percentile_row(df, "score", {"threshold": 0.15}))
    marked = add_batch_severity(decided.withColumn("is_anomaly", decide(F.col("score"), F.col("threshold"))))
    return marked.select("source_id", "reading_date", "generation_wh", "score", "is_anomaly", "severity")


@query(
    "J07_scalar_to_rows",
    f"WITH {V.READINGS} SELECT source_id, {V.DATE}, {V.r('generation_wh - (SELECT avg(generation_wh) FROM readings)', 'above_mean', 4)} FROM readings",
)
def j07(spark, sf):
    df = V.readings(spark, sf)
    mean = df.agg(F.avg("generation_wh").alias("mean"))
    above = (F.col("generation_wh") - F.col("mean")).alias("above_mean")
    return V.rounded(O.with_scalar(df, mean).select("source_id", "reading_date", above), ["above_mean"], 4)


@query(
    "M11_validate_model",
    f"""WITH {V.SCORED}, c AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS p, avg(score) FILTER (is_anomaly) AS m,
      count(*) FILTER (is_anomaly AND month(reading_date) = 6) AS tp, count(*) FILTER (is_anomaly AND month(reading_date) <> 6) AS fp,
      count(*) FILTER (NOT is_anomaly AND month(reading_date) = 6) AS fn FROM scored)
    SELECT n AS total_samples, p AS anomalies_detected, {V.r('p / n', 'anomaly_rate')}, {V.r('COALESCE(m, 0)', 'mean_anomaly_score')},
      tp AS true_positives, fp AS false_positives, fn AS false_negatives, {V.r('COALESCE(tp / NULLIF(tp + fp, 0), 0)', 'precision')},
      {V.r('COALESCE(tp / NULLIF(tp + fn, 0), 0)', 'recall')}, {V.r('COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0)', 'f1_score')} FROM c""",
)
def m11(spark, sf):
    df = V.scored(spark, sf)
    metrics = tuning.validation_metrics(df, df.where(F.month("reading_date") == 6))
    return V.rounded(metrics, ["anomaly_rate", "mean_anomaly_score", "precision", "recall", "f1_score"])


# --- Normalisation ---------------------------------------------------------------------------


def _z(center: str, scale: str, digits: int = 6) -> str:
    return ", ".join(
        V.r(f"({m} - {center.format(m=m)}) / COALESCE(NULLIF({scale.format(m=m)}, 0), 1)", m, digits) for m in S.MEASURES
    )


def _normalized(method):
    def run(spark, sf):
        df = materialize(V.readings(spark, sf), "readings")
        scaled = scaling.apply_scaler(df, scaling.fit_scaler(df, S.MEASURES, method), S.MEASURES)
        return V.rounded(scaled.select("source_id", "reading_date", *S.MEASURES), S.MEASURES)

    return run


query(
    "N01_global_z_score",
    f"WITH {V.READINGS} SELECT source_id, {V.DATE}, {_z('avg({m}) OVER ()', 'stddev_pop({m}) OVER ()')} FROM readings",
)(_normalized("global"))
_BY_SOURCE = "(PARTITION BY source_id)"
query(
    "N02_site_z_score",
    f"WITH {V.READINGS} SELECT source_id, {V.DATE}, {_z('avg({m}) OVER ' + _BY_SOURCE, 'stddev_pop({m}) OVER ' + _BY_SOURCE)} FROM readings",
)(_normalized("per_company"))
_QUARTILES = ", ".join(f"quantile_cont({m}, 0.25) AS {m}_a, quantile_cont({m}, 0.5) AS {m}_b, quantile_cont({m}, 0.75) AS {m}_c" for m in S.MEASURES)
query(
    "N03_robust_scale",
    f"WITH {V.READINGS}, q AS (SELECT {_QUARTILES} FROM readings) SELECT source_id, {V.DATE}, {_z('{m}_b', '({m}_c - {m}_a)')} FROM readings, q",
)(_normalized("robust"))

_FEATURE_SQL = {
    **{m: m for m in S.MEASURES},
    "generation_consumption_ratio": "generation_wh / (consumption_wh + 1e-6::DOUBLE)",
    "generation_consumption_diff": "generation_wh - consumption_wh",
    "self_consumption_efficiency": "self_consumption_wh / (generation_wh + 1e-6::DOUBLE)",
    "grid_balance": "grid_export_wh - grid_import_wh",
    "day": "day(reading_date)",
    "month": "month(reading_date)",
    "weekday": "isodow(reading_date) - 1",
    "is_weekend": "CAST(isodow(reading_date) >= 6 AS INTEGER)",
}


def _feature_z() -> str:
    parts = []
    for name, e in _FEATURE_SQL.items():
        x = f"CAST({e} AS DOUBLE)"
        parts.append(V.r(f"({x} - avg({x}) OVER ()) / COALESCE(NULLIF(stddev_pop({x}) OVER (), 0), 1)", name))
    return ", ".join(parts)


@query("N05_feature_z_score", f"WITH {V.STRESSED} SELECT source_id, {_feature_z()} FROM stressed")
def n05(spark, sf):
    df = with_features(materialize(V.stressed(spark, sf), "readings"))
    scaled = scaling.apply_scaler(df, scaling.fit_scaler(df, S.FEATURES), S.FEATURES)
    return V.rounded(scaled.select("source_id", *S.FEATURES), S.FEATURES)


# A scaler fitted on the rows before 1998 meets later sources it does not know.
_OLD = "year(reading_date) < 1998"
_STORED = f"""f AS (SELECT source_id, avg(generation_wh) AS mean, stddev_pop(generation_wh) AS dev FROM readings WHERE {_OLD} GROUP BY source_id)
    SELECT source_id, {V.DATE}, {V.r('COALESCE((generation_wh - mean) / COALESCE(NULLIF(dev, 0), 1), generation_wh)', 'generation_wh')}
    FROM readings LEFT JOIN f USING (source_id)"""


def _stored_scaler(spark, sf):
    df = materialize(V.readings(spark, sf), "readings")
    scaler = scaling.fit_scaler(df.where(F.year("reading_date") < 1998), ["generation_wh"], "per_company")
    scaled = scaling.apply_scaler(df, scaler, ["generation_wh"])
    return V.rounded(scaled.select("source_id", "reading_date", "generation_wh"), ["generation_wh"])


query("J01_site_scaler_lookup", f"WITH {V.READINGS}, {_STORED}")(_stored_scaler)


@query(
    "N06_stored_scaler",
    f"""WITH {V.READINGS}, f AS (SELECT {', '.join(f'avg({m}) AS {m}_c, stddev_pop({m}) AS {m}_s' for m in S.MEASURES)} FROM readings WHERE {_OLD})
    SELECT source_id, {V.DATE}, {_z('{m}_c', '{m}_s')} FROM readings, f""",
)
def n06(spark, sf):
    df = materialize(V.readings(spark, sf), "readings")
    scaler = scaling.fit_scaler(df.where(F.year("reading_date") < 1998), S.MEASURES)
    stored = materialize(scaler, "stored_scaler")
    scaled = scaling.apply_scaler(df, stored, S.MEASURES)
    return V.rounded(scaled.select("source_id", "reading_date", *S.MEASURES), S.MEASURES)


# --- Sorts and limits ------------------------------------------------------------------------


@query("L01_anomalies_by_score", f"WITH {V.SCORED} SELECT source_id, {V.DATE}, score FROM scored WHERE is_anomaly ORDER BY score, source_id, reading_date")
def l01(spark, sf):
    return reports.anomalies_by_score(V.scored(spark, sf)).select("source_id", "reading_date", "score")


@query("L02_worst_anomalies", f"WITH {V.SCORED} SELECT source_id, {V.DATE}, score FROM scored WHERE is_anomaly ORDER BY score, source_id, reading_date LIMIT 10")
def l02(spark, sf):
    return reports.worst_anomalies(V.scored(spark, sf)).select("source_id", "reading_date", "score")


@query(
    "L03_top_sites",
    f"""WITH {V.SCORED}, report AS ({_REPORT})
    SELECT * FROM (SELECT 'records' AS ranking, site_id, records, anomalies, mean_score FROM report ORDER BY records DESC, site_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'anomalies', site_id, records, anomalies, mean_score FROM report ORDER BY anomalies DESC, site_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'mean_score', site_id, records, anomalies, mean_score FROM report ORDER BY mean_score, site_id LIMIT 10)""",
)
def l03(spark, sf):
    report = materialize(_report(spark, sf).select("site_id", "records", "anomalies", "mean_score"), "report")
    ranked = lambda name, *order: reports.top_n(report, [*order, F.asc("site_id")]).withColumn("ranking", F.lit(name))
    return (
        ranked("records", F.desc("records"))
        .unionByName(ranked("anomalies", F.desc("anomalies")))
        .unionByName(ranked("mean_score", F.asc("mean_score")))
    )


@query("L04_most_frequent_sites", f"WITH {V.READINGS} SELECT source_id, count(*) AS records FROM readings GROUP BY source_id ORDER BY records DESC, source_id LIMIT 10")
def l04(spark, sf):
    return reports.most_frequent_sites(V.readings(spark, sf))


@query("L05_retain_newest", f"""WITH {V.ALERTS} SELECT event_id, empresa, score FROM alerts ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000""")
def l05(spark, sf):
    return O.newest(V.alerts(spark, sf), ["timestamp", "event_id"]).select("event_id", "empresa", "score")


@query(
    "L05_retain_newest_per_site",
    f"""WITH {V.ALERTS} SELECT event_id, empresa, score FROM alerts
    QUALIFY row_number() OVER (PARTITION BY empresa ORDER BY "timestamp" DESC, event_id DESC) <= 20""",
)
def l05_site(spark, sf):
    order = [F.desc("timestamp"), F.desc("event_id")]
    return O.top_k_per_group(V.alerts(spark, sf), ["empresa"], order, 20).select("event_id", "empresa", "score")


@query(
    "L06_positional_split",
    f"""WITH {V.READINGS}, p AS (SELECT source_id, {V.DATE}, row_number() OVER (ORDER BY reading_date, source_id) AS i, count(*) OVER () AS n FROM readings)
    SELECT source_id, {V.DATE}, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'validation' END AS part FROM p""",
)
def l06(spark, sf):
    df = V.readings(spark, sf).select("source_id", "reading_date")
    first, rest = O.split_by_position(df, 0.8, "reading_date", ["source_id"])
    return first.withColumn("part", F.lit("train")).unionByName(rest.withColumn("part", F.lit("validation")))


@query("L07_last_readings", f"WITH {V.READINGS} SELECT source_id, {V.DATE}, generation_wh FROM readings ORDER BY reading_date DESC, source_id DESC LIMIT 10")
def l07(spark, sf):
    return O.newest(V.readings(spark, sf), ["reading_date", "source_id"], 10).select("source_id", "reading_date", "generation_wh")


@query("L08_score_series", f"WITH {V.SCORED} SELECT {V.DATE}, source_id, score, is_anomaly FROM scored ORDER BY reading_date, source_id")
def l08(spark, sf):
    return reports.score_series(V.scored(spark, sf))


@query(
    "L10_busiest_alert_sites",
    f"""WITH {V.ALERTS} SELECT 'site' AS dimension, empresa AS key, count(*) AS alerts FROM alerts
    WHERE "timestamp" > {_AS_OF} - INTERVAL 7 DAY GROUP BY empresa ORDER BY alerts DESC, key LIMIT 10""",
)
def l10(spark, sf):
    return A.busiest_sites(a08(spark, sf))


@query(
    "M16_fleet_report",
    f"""WITH {V.SCORED}, report AS ({_REPORT}),
    t AS (SELECT count(*) AS fleet_records, count(*) FILTER (is_anomaly) AS fleet_anomalies, min(score) FILTER (is_anomaly) AS marker FROM scored)
    SELECT report.*, fleet_records, fleet_anomalies, {V.r('marker', 'threshold_marker')},
      {V.r('records * 100.0 / fleet_records', 'share_percent')} FROM report, t""",
)
def m16(spark, sf):
    scored = materialize(V.scored(spark, sf).withColumn("source_id", F.col("site_id")), "scored")
    tables = fleet_report(scored)
    totals = tables["summary"].select(F.col("total").alias("fleet_records"), F.col("anomalies").alias("fleet_anomalies"))
    out = (
        tables["site_report"]
        .join(tables["rows_per_site"].select("source_id", "share_percent"), "source_id")
        .crossJoin(F.broadcast(totals))
        .crossJoin(F.broadcast(tables["threshold_marker"]))
        .withColumnRenamed("source_id", "site_id")
    )
    out = V.rounded(out, ["anomaly_rate", "mean_score", "threshold_marker", "share_percent"])
    return V.rounded(out, ["mean_generation", "mean_consumption"], 4)


def _cells_sql(table: str, key: str, columns: list[str], source: str) -> str:
    """One row for each cell of a report table: its name, its row's key, the column and the value."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS report_table, CAST({key} AS VARCHAR) AS key, '{c}' AS measure, {V.r(f'CAST({c} AS DOUBLE)', 'value', 4)} FROM ({source})"
        for c in columns
    )


_COUNTED = ["records", "anomalies", "anomaly_rate", "mean_score", "mean_generation", "mean_consumption"]
_RAW_REPORT = f"""SELECT site_id, count(*) AS records, count(*) FILTER (is_anomaly) AS anomalies, {_RATE} AS anomaly_rate,
    avg(score) AS mean_score, avg(generation_wh) AS mean_generation, avg(consumption_wh) AS mean_consumption FROM scored GROUP BY site_id"""


def _top_sql(table: str, order: str) -> str:
    placed = f"SELECT *, row_number() OVER (ORDER BY {order}, site_id) AS rank FROM report"
    return _cells_sql(table, "site_id", ["rank", *_COUNTED], f"SELECT * FROM ({placed}) WHERE rank <= 10")


def _histogram_sql() -> str:
    body = ORACLES["A12_score_histogram"].removeprefix(f"WITH {V.SCORED}, ")
    return _cells_sql("score_histogram", "bin", ["lower", "upper", "rows"], f"WITH {body}")


@query(
    "M16_fleet_report_tables",
    f"WITH {V.SCORED}, report AS ({_RAW_REPORT}) "
    + " UNION ALL ".join(
        [
            _cells_sql("rows_per_site", "site_id", ["records", "share_percent"], "SELECT site_id, records, records * 100.0 / sum(records) OVER () AS share_percent FROM report"),
            _cells_sql("anomalies_per_site", "site_id", ["anomalies"], "SELECT * FROM report WHERE anomalies > 0"),
            _cells_sql("site_report", "site_id || ' ' || rate_band", _COUNTED, f"SELECT *, {_BAND_OF_RATE} AS rate_band FROM report"),
            _cells_sql("summary", "'all'", ["total", "normal", "anomalies", "anomaly_percent"], f"SELECT count(*) AS total, count(*) FILTER (NOT is_anomaly) AS normal, count(*) FILTER (is_anomaly) AS anomalies, {_RATE} AS anomaly_percent FROM scored"),
            _cells_sql("executive_summary", "largest_site || ' ' || worst_site", ["sites", "records", "anomalies", "anomaly_rate", "largest_site_records", "worst_site_anomalies"], f"WITH {_EXECUTIVE}"),
            _histogram_sql(),
            _cells_sql("threshold_marker", "'all'", ["threshold_marker"], "SELECT min(score) FILTER (is_anomaly) AS threshold_marker FROM scored"),
            _cells_sql("box_plots", "site_id", ["q1", "median", "q3", "lower_whisker", "upper_whisker", "outliers"], f"WITH {_BOX}"),
            _top_sql("top_by_records", "records DESC"),
            _top_sql("top_by_anomalies", "anomalies DESC"),
            _top_sql("lowest_mean_scores", "mean_score"),
        ]
    ),
)
def m16_tables(spark, sf):
    """All eleven tables of the report, a row for each cell."""
    scored = V.scored(spark, sf).withColumn("source_id", F.col("site_id"))
    report = fleet_report(materialize(scored, "scored"))
    keys = {
        "site_report": F.concat_ws(" ", "source_id", "rate_band"), "executive_summary": F.concat_ws(" ", "largest_site", "worst_site"),
        "summary": F.lit("all"), "threshold_marker": F.lit("all"), "score_histogram": F.col("bin").cast("string"),
    }
    parts = []
    for name, rows in report.items():
        if name.startswith("top_") or name.startswith("lowest_"):
            rows = _ranked(rows, name)
        measures = [c for c, t in rows.dtypes if t != "string" and c != "bin"]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures]))
        long = rows.select(keys.get(name, F.col("source_id")).alias("key"), cells.alias("cell"))
        parts.append(long.select(F.lit(name).alias("report_table"), "key", "cell.measure", "cell.value"))
    return V.rounded(functools.reduce(DataFrame.unionByName, parts), ["value"], 4)


def _ranked(rows, name):
    """The ten rows of a ranking with their places; ten rows need one task only."""
    first = {"top_by_records": F.desc("records"), "top_by_anomalies": F.desc("anomalies"), "lowest_mean_scores": F.asc("mean_score")}[name]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(first, F.asc("source_id"))))


_BANDS = "CASE WHEN {s} < -0.5 THEN 'CRÍTICA' WHEN {s} < -0.3 THEN 'ALTA' WHEN {s} < -0.1 THEN 'MEDIA' ELSE 'BAJA' END"


@query("P18_score_severity", f"WITH {V.SCORED} SELECT source_id, {V.DATE}, score, {_BANDS.format(s='score')} AS severidad FROM scored")
def p18(spark, sf):
    return V.scored(spark, sf).select("source_id", "reading_date", "score", sev.score_severity(F.col("score")).alias("severidad"))


@query(
    "P20_score_alert",
    f"""WITH {V.SCORED} SELECT '2024-02-01 00:00:00' AS "timestamp", strftime(reading_date, '%d.%m.%Y') AS fecha_dato, source_id AS empresa,
    is_anomaly AS es_anomalia, score, {_BANDS.format(s='score')} AS severidad, generation_wh AS generacion, consumption_wh AS consumo,
    self_consumption_wh AS autoconsumo FROM scored WHERE is_anomaly""",
)
def p20(spark, sf):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    flat = A.score_alerts(A.alert_gate(V.scored(spark, sf)), at)
    datos = F.col("datos")
    return flat.select(
        F.col("timestamp").cast("string").alias("timestamp"), "fecha_dato", "empresa", "es_anomalia", "score", "severidad",
        datos.getField("Generación total").alias("generacion"), datos.getField("Consumo total").alias("consumo"),
        datos.getField("Autoconsumo").alias("autoconsumo"),
    )
