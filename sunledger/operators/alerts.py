"""Alerts: gates, records and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions import severity as V
from sunledger.operators.trends import SERIES

_DATOS = {"Generación total": "generation_wh", "Consumo total": "consumption_wh", "Autoconsumo": "self_consumption_wh"}


def alert_gate(scored: DataFrame) -> DataFrame:
    """Rows a batch job alerts on: the anomalies."""
    return scored.where("is_anomaly")


def prediction_gate(analyzed: DataFrame) -> DataFrame:
    """Rows the prediction job alerts on: anomalies and rows with a future risk."""
    return analyzed.where(F.col("is_anomaly") | F.col("has_risk"))


def score_alerts(scored: DataFrame, at: Column | None = None, site: str = "source_id") -> DataFrame:
    """One alert per row, its severity from the score. ``at`` is the alert's time (now by default)."""
    return scored.select(
        _timestamp(at),
        _reading_date(scored),
        _site(scored, site),
        F.coalesce("is_anomaly", F.lit(False)).alias("es_anomalia"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        V.score_severity(F.col("score")).alias("severidad"),
        _values(scored),
    )


def classify(analyzed: DataFrame) -> DataFrame:
    """Add current and future problem, severity, problem types and description."""
    g, c, a = F.col("generation_wh"), F.col("consumption_wh"), F.col("self_consumption_wh")
    labelled = analyzed.withColumns(
        {
            "current_problem": V.current_problem(F.col("is_anomaly"), g, c, a),
            "future_problem": V.future_problem(F.col("has_risk"), F.col("risk_score")),
        }
    )
    now, later = F.col("current_problem"), F.col("future_problem")
    return labelled.withColumns(
        {
            "problem_severity": V.problem_severity(now, later),
            "problem_types": V.problem_types(now, later),
            "description": V.problem_description(now, later, F.col("risk_message")),
            "alert_type": V.alert_type(F.col("is_anomaly")),
        }
    )


def problem_alerts(classified: DataFrame, at: Column | None = None, site: str = "site_id") -> DataFrame:
    """One extended alert per row, with problem types, risk and the trends behind it."""
    trends = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("generacion", "consumo", "eficiencia")]),
        F.array(*[_trend(n) for n in SERIES]),
    )
    no_trends = F.map_filter(trends, lambda k, v: F.lit(False))
    return classified.select(
        _timestamp(at),
        _reading_date(classified),
        _site(classified, site),
        F.col("alert_type").alias("tipo_alerta"),
        F.coalesce("is_anomaly", F.lit(False)).alias("es_anomalia_actual"),
        F.col("has_risk").alias("hay_riesgo_futuro"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("risk_score").alias("riesgo_score"),
        F.col("problem_severity").alias("severidad"),
        F.col("problem_types").alias("tipos_problema"),
        F.col("description").alias("descripcion"),
        F.col("risk_message").alias("prediccion_mensaje"),
        _values(classified),
        F.when(F.col("history_rows") >= S.MIN_HISTORY, trends).otherwise(no_trends).alias("tendencias"),
    )


def recent_alerts(alerts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Alerts later than ``days`` days before ``as_of``, that instant itself excluded."""
    return alerts.where(F.col("timestamp") > as_of - F.make_dt_interval(F.lit(days)))


def alert_summary(alerts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Counts in total, of the last 24 hours, per severity and per site: ``(dimension, key, alerts)``.

    One aggregate over grouping sets; without alerts the total and the last-day rows are 0.
    """
    last_day = F.count_if(F.col("timestamp") > as_of - F.make_dt_interval(F.lit(1)))
    grouped = (
        recent_alerts(alerts, as_of, days)
        .groupingSets([["severidad"], ["empresa"], []], "severidad", "empresa")
        .agg(F.count(F.lit(1)).alias("n"), last_day.alias("recent"), F.grouping_id().alias("level"))
    )
    # grouping_id: severity and site are its two bits; a set bit marks a column that is rolled up.
    entry = lambda dimension, key, n: F.struct(
        F.lit(dimension).alias("dimension"), key.alias("key"), n.alias("alerts")
    )
    none = F.lit(None).cast("string")
    rows = (
        F.when(F.col("level") == 1, F.array(entry("severity", F.col("severidad"), F.col("n"))))
        .when(F.col("level") == 2, F.array(entry("site", F.col("empresa"), F.col("n"))))
        .otherwise(F.array(entry("total", none, F.col("n")), entry("last_24h", none, F.col("recent"))))
    )
    counted = grouped.select(F.explode(rows).alias("row")).select("row.*")
    # Grouping sets return nothing for no input, so the two totals are added as zeros.
    zeros = alerts.sparkSession.createDataFrame([("total", None, 0), ("last_24h", None, 0)], counted.schema)
    return counted.unionByName(zeros).groupBy("dimension", "key").agg(F.sum("alerts").alias("alerts"))


def busiest_sites(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sites with most alerts; ties go by name."""
    return summary.where("dimension = 'site'").orderBy(F.desc("alerts"), "key").limit(n)


def _timestamp(at: Column | None) -> Column:
    return (F.current_timestamp() if at is None else at).alias("timestamp")


def _reading_date(df: DataFrame) -> Column:
    if "reading_date" not in df.columns:
        return F.lit(S.UNKNOWN_VALUE).alias("fecha_dato")
    text = F.date_format("reading_date", S.DATE_FORMAT)
    return F.coalesce(text, F.lit(S.UNKNOWN_VALUE)).alias("fecha_dato")


def _site(df: DataFrame, site: str) -> Column:
    if site not in df.columns:
        return F.lit(S.UNKNOWN_SITE).alias("empresa")
    return F.coalesce(F.col(site).cast("string"), F.lit(S.UNKNOWN_SITE)).alias("empresa")


def _values(df: DataFrame) -> Column:
    null = F.lit(None).cast("double")
    fields = [(F.col(c) if c in df.columns else null).alias(h) for h, c in _DATOS.items()]
    return F.struct(*fields).alias("datos")


def _trend(name: str) -> Column:
    return F.struct(
        F.col(f"{name}_trend").alias("tendencia"),
        F.col(f"{name}_speed").alias("velocidad"),
        F.col(f"{name}_change").alias("cambio_actual"),
        F.col(f"{name}_recent").alias("valores_historicos"),
    )
