"""Scans of stored history and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions.readings import to_timestamp_iso
from sunledger.storage import path_exists


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """History records kept as a JSON array of nested objects."""
    return spark.read.schema(S.HISTORY_SCHEMA).json(path, multiLine=True)


def history_readings(history: DataFrame) -> DataFrame:
    """Flat readings keyed by site and timestamp from nested history records."""
    return history.select(
        F.coalesce("empresa", F.lit(S.UNKNOWN_SITE)).alias("site_id"),
        to_timestamp_iso("timestamp").alias("reading_ts"),
        F.col("datos").getField("Generación total").alias("generation_wh"),
        F.col("datos").getField("Consumo total").alias("consumption_wh"),
        F.col("datos").getField("Autoconsumo").alias("self_consumption_wh"),
        F.coalesce("es_anomalia", F.lit(False)).alias("is_anomaly"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet store, or None where nothing has been stored yet."""
    return spark.read.parquet(path) if path_exists(spark, path) else None
