"""Data model: column names, labels and thresholds shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: source file headers ---------------------------------------------------
DATE_HEADERS = ["Fecha", "Fecha y hora"]
SITE_HEADER = "Empresa"
DATE_FORMAT = "dd.MM.yyyy"
DATE_PARSE_FORMAT = "d.M.yyyy"  # one or two digits
HEADER_TO_COLUMN = {
    "Generación total": "generation_wh",
    "Consumo total": "consumption_wh",
    "Autoconsumo": "self_consumption_wh",
    "Energía suministrada a la red": "grid_export_wh",
    "Energía obtenida de la red": "grid_import_wh",
}
RESULT_HEADERS = {
    "is_anomaly": "Es_Anomalia",
    "score": "Score_Anomalia",
    "severity": "Severidad",
}
UNITS_ROW = ["[dd.MM.yyyy]", "[Wh]", "[Wh]", "[Wh]", "[Wh]", "[Wh]"]
SOURCE_PREFIXES = ["datos_energia_", "datos_"]
SOURCE_FOLDER = "source"

# --- Fixed values: feature order and the names the features carry in exported metadata ----
MEASURES = list(HEADER_TO_COLUMN.values())
FEATURES = [
    "generation_wh",
    "consumption_wh",
    "self_consumption_wh",
    "grid_export_wh",
    "grid_import_wh",
    "generation_consumption_ratio",
    "generation_consumption_diff",
    "self_consumption_efficiency",
    "grid_balance",
    "day",
    "month",
    "weekday",
    "is_weekend",
]
FEATURE_LABELS = {
    "generation_wh": "Generación total",
    "consumption_wh": "Consumo total",
    "self_consumption_wh": "Autoconsumo",
    "grid_export_wh": "Energía suministrada a la red",
    "grid_import_wh": "Energía obtenida de la red",
    "generation_consumption_ratio": "Ratio_Generacion_Consumo",
    "generation_consumption_diff": "Diferencia_Generacion_Consumo",
    "self_consumption_efficiency": "Eficiencia_Autoconsumo",
    "grid_balance": "Balance_Red",
    "day": "Dia",
    "month": "Mes",
    "weekday": "DiaSemana",
    "is_weekend": "EsFinSemana",
}
RATIO_EPSILON = 1e-6

# --- Fixed values: severity bands of the score and of the batch percentile ----------------
CRITICAL, HIGH, MEDIUM, LOW = "CRÍTICA", "ALTA", "MEDIA", "BAJA"
SEVERITY_RANK = {LOW: 0, MEDIUM: 1, HIGH: 2, CRITICAL: 3}
SCORE_BANDS = [(-0.5, CRITICAL), (-0.3, HIGH), (-0.1, MEDIUM)]
BATCH_HIGH, BATCH_NORMAL = "Alta", "Normal"
SEVERITY_PERCENTILE = 0.10

# --- Fixed values: traffic light of a site's anomaly rate, in percent ---------------------
RATE_BANDS = [(5.0, "red"), (2.0, "orange")]
RATE_DEFAULT = "green"

# --- Fixed values: problem classification -------------------------------------------------
GENERATION_FAULT = "FALLO EN GENERACIÓN"
EXCESS_CONSUMPTION = "CONSUMO EXCESIVO"
LOW_EFFICIENCY = "BAJA EFICIENCIA DE AUTOCONSUMO"
GENERAL_ANOMALY = "ANOMALÍA GENERAL"
FUTURE_CRITICAL = "RIESGO CRÍTICO FUTURO"
FUTURE_HIGH = "RIESGO ALTO FUTURO"
FUTURE_MODERATE = "RIESGO MODERADO FUTURO"
GENERATION_FAULT_SHARE = 0.1
EXCESS_CONSUMPTION_FACTOR = 3
LOW_EFFICIENCY_BELOW = 0.5
FUTURE_CRITICAL_ABOVE = 0.7
FUTURE_HIGH_ABOVE = 0.5

# --- Fixed values: texts ------------------------------------------------------------------
TEXT_GENERATION_FAULT = (
    "⚠️ FALLO DETECTADO: La generación es extremadamente baja. "
    "Posible fallo en paneles solares o sistema de generación."
)
TEXT_EXCESS_CONSUMPTION = (
    "⚠️ CONSUMO EXCESIVO: El consumo es mucho mayor que la generación. "
    "Revisar equipos o posibles cortocircuitos."
)
TEXT_LOW_EFFICIENCY = "⚠️ EFICIENCIA BAJA: El sistema no está aprovechando bien la energía generada."
TEXT_PREDICTION_PREFIX = "🔮 PREDICCIÓN: "
TEXT_CRITICAL_SUFFIX = " - Se recomienda acción inmediata para prevenir fallos."
TEXT_HIGH_SUFFIX = " - Monitorear de cerca en los próximos días."
TEXT_NORMAL = "✅ Sistema funcionando normalmente"
# Own wording: these two labels would otherwise be described as "normal".
TEXT_GENERAL_ANOMALY = "Comportamiento anómalo sin causa identificada: conviene revisar el sitio."
TEXT_MODERATE_SUFFIX = " - Riesgo moderado: seguir la evolución."
TEXT_SEPARATOR = " | "

RISK_CONSUMPTION = "Consumo aumentando rápidamente - Posible sobrecarga futura"
RISK_GENERATION = "Generación disminuyendo - Posible fallo en paneles"
RISK_EFFICIENCY = "Eficiencia de autoconsumo disminuyendo - Sistema perdiendo rendimiento"
RISK_DEGRADATION = "Patrón de degradación detectado - Mantenimiento recomendado"
RISK_NONE = "Sin riesgos detectados"
RISK_SEPARATOR = "; "
RISK_INSUFFICIENT = "Datos insuficientes para predicción"

ALERT_CURRENT, ALERT_PREDICTION = "ANOMALÍA ACTUAL", "PREDICCIÓN"
UNKNOWN_SITE, UNKNOWN_VALUE = "Desconocida", "N/A"

# --- Fixed values: trends and risk --------------------------------------------------------
RISING, FALLING, STABLE, INSUFFICIENT = "aumentando", "disminuyendo", "estable", "insuficiente"
HISTORY_ROWS = 7
RECENT_VALUES = 5
MIN_HISTORY = 3
MIN_DEGRADATION_ROWS = 5
TREND_BAND = 0.05
DEGRADATION_SLOPE = -0.01
CONSUMPTION_SPEED, GENERATION_SPEED, EFFICIENCY_SPEED = 0.15, 0.1, 0.1
# Weights and the cut are decimals so that 0.3 + 0.4 is exactly 0.7.
CONSUMPTION_WEIGHT, GENERATION_WEIGHT = "0.3", "0.4"
EFFICIENCY_WEIGHT, DEGRADATION_WEIGHT = "0.3", "0.5"
RISK_ABOVE = "0.3"

# --- Fixed values: retention, model and tuning defaults -----------------------------------
RETENTION_ROWS = 1000
CONTAMINATION = 0.1
N_TREES = 100
MAX_SAMPLES = 256
SEED = 42
GRID_CONTAMINATION = [0.05, 0.1, 0.15, 0.2]
GRID_TREES = [50, 100, 200]
VALIDATION_SPLIT = 0.2
HISTOGRAM_BINS = 50
NORMALIZATIONS = ["global", "per_company", "robust"]

# --- Spark types --------------------------------------------------------------------------
READING_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("reading_date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in MEASURES],
    ]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("empresa", T.StringType()),
        T.StructField(
            "datos",
            T.StructType(
                [
                    T.StructField("Generación total", T.DoubleType()),
                    T.StructField("Consumo total", T.DoubleType()),
                    T.StructField("Autoconsumo", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("es_anomalia", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)
