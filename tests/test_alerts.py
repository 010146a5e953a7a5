import datetime as dt

import pytest
from helpers import series
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions import severity as V
from sunledger.operators import alerts as A
from sunledger.plans.jobs import predict_problems


def test_score_bands_exclude_their_bounds(spark):
    scores = [-0.51, -0.5, -0.31, -0.3, -0.11, -0.1, 0.0, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r.v for r in df.select("i", V.score_severity(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == ["CRÍTICA", "ALTA", "ALTA", "MEDIA", "MEDIA", "BAJA", "BAJA", "BAJA"]


@pytest.mark.parametrize(
    "g, c, a, label",
    [
        (9.9, 100, 5, S.GENERATION_FAULT),
        (10, 100, 5, S.EXCESS_CONSUMPTION),
        (33, 100, 5, S.EXCESS_CONSUMPTION),
        (34, 100, 16, S.LOW_EFFICIENCY),
        (34, 100, 17, S.GENERAL_ANOMALY),
        (0.5, 1, 0.4, S.LOW_EFFICIENCY),
        (0, 0, 0, S.LOW_EFFICIENCY),
    ],
)
def test_current_problem(spark, g, c, a, label):
    df = spark.createDataFrame([(True, float(g), float(c), float(a)), (False, float(g), float(c), float(a))], "x boolean, g double, c double, a double")
    got = df.select(V.current_problem(F.col("x"), F.col("g"), F.col("c"), F.col("a"))).collect()
    assert [r[0] for r in got] == [label, None]


@pytest.mark.parametrize("risk, label", [(0.4, S.FUTURE_MODERATE), (0.5, S.FUTURE_MODERATE), (0.6, S.FUTURE_HIGH), (0.7, S.FUTURE_HIGH), (0.8, S.FUTURE_CRITICAL)])
def test_future_problem_and_escalation(spark, risk, label):
    df = spark.createDataFrame([(risk, p) for p in (None, S.GENERAL_ANOMALY, S.EXCESS_CONSUMPTION, S.GENERATION_FAULT)], "r double, p string")
    future = V.future_problem(F.lit(True), F.col("r"))
    rows = df.select(future, V.problem_severity(F.col("p"), future), F.size(V.problem_types(F.col("p"), future))).collect()
    order = [S.LOW, S.MEDIUM, S.HIGH, S.CRITICAL]
    own = {S.FUTURE_MODERATE: 1, S.FUTURE_HIGH: 2, S.FUTURE_CRITICAL: 3}[label]
    assert {r[0] for r in rows} == {label}
    assert [r[1] for r in rows] == [order[max(own, level)] for level in (0, 1, 2, 3)]
    assert [r[2] for r in rows] == [1, 2, 2, 2]


def test_extended_alert(spark):
    values = [(1000 * 0.8**i, 100, 900 * 0.6**i) for i in range(5)]
    scored = series(spark, values).withColumns({"score": F.lit(-0.6), "is_anomaly": F.col("reading_date") == "2024-01-05"})
    classified = predict_problems(scored)
    at = F.lit("2024-02-01").cast("timestamp")
    rows = {r.fecha_dato: r for r in A.problem_alerts(classified, at).collect()}
    first, last = rows["01.01.2024"], rows["05.01.2024"]
    assert first.tendencias == {} and first.tipos_problema == [] and first.descripcion == S.TEXT_NORMAL
    assert first.severidad == "BAJA" and first.tipo_alerta == "PREDICCIÓN"
    assert last.tipo_alerta == "ANOMALÍA ACTUAL" and last.tipos_problema == [S.LOW_EFFICIENCY, S.FUTURE_HIGH]
    assert last.severidad == "ALTA" and last.riesgo_score == 0.7
    assert last.tendencias["generacion"].tendencia == "disminuyendo"
    assert last.tendencias["generacion"].valores_historicos == [v[0] for v in values[:4]]
    assert last.descripcion.endswith("Monitorear de cerca en los próximos días.")
    assert A.prediction_gate(classified).count() == 2  # the fourth row has three falling predecessors


def test_summary_bounds_and_empty_history(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [
        (now - dt.timedelta(days=7), "A", "ALTA"),
        (now - dt.timedelta(days=7) + dt.timedelta(seconds=1), "A", "ALTA"),
        (now - dt.timedelta(days=1), "B", "BAJA"),
        (now - dt.timedelta(hours=1), "B", "ALTA"),
    ]
    alerts = spark.createDataFrame(rows, "timestamp timestamp, empresa string, severidad string")
    as_of = F.lit(now).cast("timestamp")
    got = {(r.dimension, r.key): r.alerts for r in A.alert_summary(alerts, as_of).collect()}
    assert got == {
        ("total", None): 3, ("last_24h", None): 1, ("severity", "ALTA"): 2, ("severity", "BAJA"): 1, ("site", "A"): 1, ("site", "B"): 2,
    }
    empty = {(r.dimension, r.key): r.alerts for r in A.alert_summary(alerts.limit(0), as_of).collect()}
    assert empty == {("total", None): 0, ("last_24h", None): 0}
    assert [r.key for r in A.busiest_sites(A.alert_summary(alerts, as_of)).collect()] == ["B", "A"]
