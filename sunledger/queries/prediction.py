"""Windows over a site's history, risk, problem classification and extended alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sunledger.operators import alerts as A
from sunledger.operators import reports
from sunledger.operators.trends import SERIES, analyze_trends, relative_change
from sunledger.plans.jobs import predict_problems
from sunledger.queries import views as V
from sunledger.queries.registry import query
from sunledger.storage import scratch_path
from sunledger.streaming import trends as ST


def trend_sql(source: str, order: str = "reading_date") -> str:
    """CTEs ``trend`` and ``risk`` over ``source``."""
    label = lambda n: (
        f"CASE WHEN history_rows < 2 THEN 'insuficiente' WHEN m_{n} > 0.05 THEN 'aumentando' "
        f"WHEN m_{n} < -0.05 THEN 'disminuyendo' ELSE 'estable' END AS {n}_trend"
    )
    speed = lambda n: f"CASE WHEN history_rows >= 2 AND m_{n} IS NOT NULL THEN abs(m_{n}) ELSE 0 END AS {n}_speed"
    change = lambda n, x: (
        f"CASE WHEN history_rows >= 2 AND m_{n} IS NOT NULL THEN CASE WHEN p_{n} > 0 THEN ({x} - p_{n}) / greatest(p_{n}, 1) ELSE 0 END END AS {n}_change"
    )
    x = {"generation": "generation_wh", "consumption": "consumption_wh", "efficiency": "eff"}
    return f""",
eff AS (SELECT *, self_consumption_wh / greatest(generation_wh, 1) AS eff,
    CASE WHEN generation_wh > 0 THEN self_consumption_wh / generation_wh END AS yield_ FROM {source}),
lagged AS (SELECT *, {', '.join(f'lag({e}) OVER w AS p_{n}' for n, e in x.items())},
    sum(CASE WHEN generation_wh > 0 THEN 1 ELSE 0 END) OVER w AS idx
    FROM eff WINDOW w AS (PARTITION BY site_id ORDER BY {order})),
changes AS (SELECT *, {', '.join(f'CASE WHEN p_{n} > 0 THEN ({e} - p_{n}) / p_{n} END AS c_{n}' for n, e in x.items())} FROM lagged),
means AS (SELECT *, count(*) OVER h AS history_rows, {', '.join(f'avg(c_{n}) OVER p AS m_{n}' for n in x)},
    CASE WHEN count(yield_) OVER h >= 5 THEN regr_slope(yield_, CAST(idx AS DOUBLE)) OVER h END AS degradation_slope,
    string_agg(CAST(CAST(round(generation_wh) AS BIGINT) AS VARCHAR), ',') OVER v AS recent
    FROM changes WINDOW h AS (PARTITION BY site_id ORDER BY {order} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
      p AS (PARTITION BY site_id ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
      v AS (PARTITION BY site_id ORDER BY {order} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
trend AS (SELECT *, {', '.join(label(n) for n in x)}, {', '.join(speed(n) for n in x)}, {', '.join(change(n, e) for n, e in x.items())} FROM means),
found AS (SELECT *, consumption_trend = 'aumentando' AND consumption_speed > 0.15 AS f1, generation_trend = 'disminuyendo' AND generation_speed > 0.1 AS f2,
    efficiency_trend = 'disminuyendo' AND efficiency_speed > 0.1 AS f3, COALESCE(round(degradation_slope, 12) < -0.01::DOUBLE, FALSE) AS f4 FROM trend),
summed AS (SELECT *, CASE WHEN f1 THEN 0.3 ELSE 0.0 END + CASE WHEN f2 THEN 0.4 ELSE 0.0 END + CASE WHEN f3 THEN 0.3 ELSE 0.0 END
    + CASE WHEN f4 THEN 0.5 ELSE 0.0 END AS total FROM found),
risk AS (SELECT *, CASE WHEN history_rows >= 3 THEN CAST(total AS DOUBLE) ELSE 0 END AS risk_score, history_rows >= 3 AND total > 0.3 AS has_risk,
    CASE WHEN history_rows >= 3 THEN least(history_rows / 7.0::DOUBLE, 1) ELSE 0 END AS confidence,
    CASE WHEN history_rows < 3 THEN 'Datos insuficientes para predicción' ELSE COALESCE(NULLIF(concat_ws('; ',
      CASE WHEN f1 THEN 'Consumo aumentando rápidamente - Posible sobrecarga futura' END,
      CASE WHEN f2 THEN 'Generación disminuyendo - Posible fallo en paneles' END,
      CASE WHEN f3 THEN 'Eficiencia de autoconsumo disminuyendo - Sistema perdiendo rendimiento' END,
      CASE WHEN f4 THEN 'Patrón de degradación detectado - Mantenimiento recomendado' END), ''), 'Sin riesgos detectados') END AS risk_message
    FROM summed)"""


_TREND = V.STRESSED_SCORED + trend_sql("scored")
_DOUBLES = [f"{n}_{k}" for n in SERIES for k in ("speed", "change")] + ["degradation_slope", "confidence"]


def _sql(*columns: str, source: str = "risk", where: str = "", key: str = f"site_id, {V.DATE}", base: str = _TREND) -> str:
    parts = [V.r(c, c) if c in _DOUBLES else c for c in columns]
    return f"WITH {base} SELECT {key}, {', '.join(parts)} FROM {source} {where}"


def _analyzed(spark, sf):
    return analyze_trends(V.stressed_scored(spark, sf))


def _pick(*columns):
    def run(spark, sf):
        df = _analyzed(spark, sf).select("site_id", "reading_date", *columns)
        return V.rounded(df, [c for c in columns if c in _DOUBLES])

    return run


def _trend_query(key, *columns):
    query(key, _sql(*columns))(_pick(*columns))


_trend_query("W01_history_rows", "history_rows")
_trend_query("W03_mean_change", "generation_speed", "consumption_speed")
_trend_query("W04_trend_label", "generation_trend", "consumption_trend")
_trend_query("W05_speed_and_change", "generation_speed", "generation_change", "consumption_speed", "consumption_change")
_trend_query("W07_efficiency_trend", "efficiency_trend", "efficiency_speed", "efficiency_change")
_trend_query("W08_degradation", "degradation_slope")
_trend_query("P26_risk_message", "risk_message")
_trend_query("P28_confidence", "confidence")
_trend_query("P30_risk_score", "risk_score", "has_risk")


@query(
    "W02_relative_change",
    f"WITH {_TREND} SELECT site_id, {V.DATE}, {V.r('c_generation', 'change')} FROM changes",
)
def w02(spark, sf):
    previous = F.lag("generation_wh").over(Window.partitionBy("site_id").orderBy("reading_date"))
    df = V.stressed(spark, sf).select(
        "site_id", "reading_date", relative_change(previous, F.col("generation_wh")).alias("change")
    )
    return V.rounded(df, ["change"])


def _joined(values):
    text = F.transform(values, lambda x: F.round(x).cast("long").cast("string"))
    return F.array_join(text, ",")


@query("W06_recent_values", f"WITH {_TREND} SELECT site_id, {V.DATE}, CASE WHEN history_rows >= 2 AND m_generation IS NOT NULL THEN recent END AS recent FROM means")
def w06(spark, sf):
    return _analyzed(spark, sf).select("site_id", "reading_date", _joined(F.col("generation_recent")).alias("recent"))


_W09 = [
    "history_rows", *[f"{n}_trend" for n in SERIES], *_DOUBLES, "risk_score", "has_risk", "risk_message",
]
_trend_query("W09_trend_risk", *_W09)


@query(
    "W09_trend_risk_by_timestamp",
    _sql(*_W09, key="site_id, event_id", base=V.EVENT_READINGS + trend_sql("event_readings", "reading_ts, event_id")),
)
def w09_timestamp(spark, sf):
    df = analyze_trends(V.event_readings(spark, sf), ["reading_ts", "event_id"], chunk_seconds=86_400)
    return V.rounded(df.select("site_id", "event_id", *_W09), _DOUBLES)


@query("F06_site_history", f"WITH {V.READINGS} SELECT site_id, {V.DATE}, count(*) OVER (PARTITION BY site_id ORDER BY reading_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS history_rows FROM readings")
def f06(spark, sf):
    return analyze_trends(V.readings(spark, sf)).select("site_id", "reading_date", "history_rows")


def _f07(spark, sf):
    df = _analyzed(spark, sf).where("history_rows < 3")
    return V.rounded(df.select("site_id", "reading_date", "has_risk", "confidence", "risk_message"), ["confidence"])


query("F07_insufficient_history", _sql("has_risk", "confidence", "risk_message", where="WHERE history_rows < 3"))(_f07)


# --- Classification --------------------------------------------------------------------------

_PROBLEMS = _TREND + """,
labelled AS (SELECT *, CASE WHEN is_anomaly THEN CASE WHEN generation_wh < consumption_wh * 0.1::DOUBLE THEN 'FALLO EN GENERACIÓN'
      WHEN consumption_wh > generation_wh * 3 THEN 'CONSUMO EXCESIVO'
      WHEN self_consumption_wh / greatest(generation_wh, 1) < 0.5 THEN 'BAJA EFICIENCIA DE AUTOCONSUMO' ELSE 'ANOMALÍA GENERAL' END END AS current_problem,
    CASE WHEN has_risk THEN CASE WHEN total > 0.7 THEN 'RIESGO CRÍTICO FUTURO' WHEN total > 0.5 THEN 'RIESGO ALTO FUTURO' ELSE 'RIESGO MODERADO FUTURO' END END AS future_problem
    FROM risk),
ranked AS (SELECT *, greatest(CASE current_problem WHEN 'FALLO EN GENERACIÓN' THEN 3 WHEN 'CONSUMO EXCESIVO' THEN 2 WHEN 'BAJA EFICIENCIA DE AUTOCONSUMO' THEN 1 WHEN 'ANOMALÍA GENERAL' THEN 1 ELSE 0 END,
      CASE future_problem WHEN 'RIESGO CRÍTICO FUTURO' THEN 3 WHEN 'RIESGO ALTO FUTURO' THEN 2 WHEN 'RIESGO MODERADO FUTURO' THEN 1 ELSE 0 END) AS level FROM labelled),
problems AS (SELECT *, CASE level WHEN 3 THEN 'CRÍTICA' WHEN 2 THEN 'ALTA' WHEN 1 THEN 'MEDIA' ELSE 'BAJA' END AS problem_severity,
    concat_ws(',', current_problem, future_problem) AS problem_types,
    CASE WHEN is_anomaly THEN 'ANOMALÍA ACTUAL' ELSE 'PREDICCIÓN' END AS alert_type,
    COALESCE(NULLIF(concat_ws(' | ', CASE current_problem
        WHEN 'FALLO EN GENERACIÓN' THEN '⚠️ FALLO DETECTADO: La generación es extremadamente baja. Posible fallo en paneles solares o sistema de generación.'
        WHEN 'CONSUMO EXCESIVO' THEN '⚠️ CONSUMO EXCESIVO: El consumo es mucho mayor que la generación. Revisar equipos o posibles cortocircuitos.'
        WHEN 'BAJA EFICIENCIA DE AUTOCONSUMO' THEN '⚠️ EFICIENCIA BAJA: El sistema no está aprovechando bien la energía generada.'
        WHEN 'ANOMALÍA GENERAL' THEN 'Comportamiento anómalo sin causa identificada: conviene revisar el sitio.' END,
      '🔮 PREDICCIÓN: ' || risk_message || CASE future_problem WHEN 'RIESGO CRÍTICO FUTURO' THEN ' - Se recomienda acción inmediata para prevenir fallos.'
        WHEN 'RIESGO ALTO FUTURO' THEN ' - Monitorear de cerca en los próximos días.'
        WHEN 'RIESGO MODERADO FUTURO' THEN ' - Riesgo moderado: seguir la evolución.' END), ''), '✅ Sistema funcionando normalmente') AS description
    FROM ranked)"""


def _problem_query(key, *columns, where=""):
    def run(spark, sf):
        df = predict_problems(V.stressed_scored(spark, sf))
        if where:
            df = df.where(where.removeprefix("WHERE "))
        if "problem_types" in columns:
            df = df.withColumn("problem_types", F.array_join("problem_types", ","))
        return V.rounded(df.select("site_id", "reading_date", *columns), [c for c in columns if c in _DOUBLES])

    query(key, _sql(*columns, source="problems", where=where, base=_PROBLEMS))(run)


_problem_query("P22_current_problem", "current_problem")
_problem_query("P23_future_problem", "future_problem", "problem_severity")
_problem_query("P24_problem_types", "problem_types")
_problem_query("P25_description", "description")
_problem_query("P27_alert_type", "alert_type")
_problem_query("F04_prediction_gate", "is_anomaly", "has_risk", where="WHERE is_anomaly OR has_risk")
_problem_query(
    "M15_problem_prediction", "generation_wh", "score", "is_anomaly", "risk_score", "has_risk", "problem_severity",
    "problem_types", "description", "risk_message",
)


P21_SQL = f"""WITH {_PROBLEMS} SELECT strftime(reading_date, '%d.%m.%Y') AS fecha_dato, site_id AS empresa, alert_type AS tipo_alerta, is_anomaly AS es_anomalia_actual,
    has_risk AS hay_riesgo_futuro, score, risk_score AS riesgo_score, problem_severity AS severidad, problem_types AS tipos_problema, description AS descripcion,
    risk_message AS prediccion_mensaje, generation_wh AS generacion, CASE WHEN history_rows >= 3 THEN generation_trend END AS tendencia_generacion,
    CASE WHEN history_rows >= 3 THEN {V.r('consumption_speed', 'x').removesuffix(' AS x')} END AS velocidad_consumo,
    CASE WHEN history_rows >= 3 AND m_generation IS NOT NULL THEN recent END AS valores_generacion
    FROM problems WHERE is_anomaly OR has_risk"""


def flat_problem_alerts(flat):
    """The alerts with the parts of their trends that the SQL has."""
    trend = lambda name, part: F.col("tendencias")[name].getField(part)
    out = flat.select(
        "fecha_dato", "empresa", "tipo_alerta", "es_anomalia_actual", "hay_riesgo_futuro", "score", "riesgo_score", "severidad",
        F.array_join("tipos_problema", ",").alias("tipos_problema"), "descripcion", "prediccion_mensaje",
        F.col("datos").getField("Generación total").alias("generacion"),
        trend("generacion", "tendencia").alias("tendencia_generacion"),
        trend("consumo", "velocidad").alias("velocidad_consumo"),
        _joined(trend("generacion", "valores_historicos")).alias("valores_generacion"),
    )
    return V.rounded(out, ["velocidad_consumo"])


@query("P21_problem_alert", P21_SQL)
def p21(spark, sf):
    classified = predict_problems(V.stressed_scored(spark, sf))
    return flat_problem_alerts(A.problem_alerts(A.prediction_gate(classified), F.lit("2024-02-01 00:00:00").cast("timestamp")))


# --- The flagship: sites with most predicted problems ----------------------------------------


@query(
    "W09_L03_sites_at_risk",
    f"""WITH {V.READINGS}{trend_sql('readings')} SELECT site_id, count(*) AS readings, count(*) FILTER (has_risk) AS at_risk,
    {V.r('avg(risk_score)', 'mean_risk')}, max(risk_score) AS max_risk FROM risk GROUP BY site_id ORDER BY at_risk DESC, site_id LIMIT 10""",
)
def sites_at_risk(spark, sf):
    per_site = (
        analyze_trends(V.readings(spark, sf))
        .groupBy("site_id")
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.count_if("has_risk").alias("at_risk"),
            F.avg("risk_score").alias("mean_risk"),
            F.max("risk_score").alias("max_risk"),
        )
    )
    return V.rounded(reports.top_n(per_site, [F.desc("at_risk"), F.asc("site_id")]), ["mean_risk"])


# --- The same trends, from a stream ----------------------------------------------------------


def _arriving(spark, sf, root, late):
    """Three parts that arrive one after the other; the stream takes up each of them where it had stopped."""
    df, year = V.stressed(spark, sf), F.year("reading_date")
    parts = [df.where(year < 1994), df.where((year >= 1994) & (year < 1996)), df.where(year >= 1996)]
    if late:
        phase = (F.col("site_id").cast("int") + F.dayofmonth("reading_date")) % 11
        parts[1:] = [parts[1].unionAll(parts[0].where(phase == 3)), parts[2].unionAll(parts[2].where(phase == 4))]
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        arrived = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        ST.stream_trends(arrived, f"{root}/out", f"{root}/late", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/late")


@query("T04_stream_trends", _sql(*_W09, base=V.STRESSED + trend_sql("stressed")))
def t04(spark, sf):
    in_order, _ = _arriving(spark, sf, scratch_path(spark, "t04"), False)
    return V.rounded(in_order.select("site_id", "reading_date", *_W09), _DOUBLES)


_LATE_PHASE = "(CAST(site_id AS INTEGER) + day(reading_date)) % 11"


@query(
    "T04_late_readings",
    f"""WITH {V.STRESSED}{trend_sql('stressed')} SELECT site_id, {V.DATE}, false AS late, risk_score, generation_wh FROM risk
    UNION ALL SELECT site_id, {V.DATE}, true, NULL, generation_wh FROM stressed
    WHERE year(reading_date) < 1994 AND {_LATE_PHASE} = 3 OR year(reading_date) >= 1996 AND {_LATE_PHASE} = 4""",
)
def t04_late(spark, sf):
    """Readings that come again, a part later or twice in one part: they come out apart and change no trend."""
    in_order, late = _arriving(spark, sf, scratch_path(spark, "t04-late"), True)
    kept = in_order.select("site_id", "reading_date", F.lit(False).alias("late"), "risk_score", "generation_wh")
    return kept.unionAll(late.select("site_id", "reading_date", F.lit(True), F.lit(None).cast("double"), "generation_wh"))
