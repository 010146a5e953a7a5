"""Readings, scores and alerts derived from the given tables, in Spark and in SQL.

``lineitem`` gives one reading per supplier (site) and ship date. Amounts are summed as whole
hundredths, so the sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger import schema as S

ANOMALY_BELOW = -0.7
# Dates leave the queries as ISO text, which both engines spell alike.
DATE = "CAST(reading_date AS VARCHAR) AS reading_date"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per site and date; a source is one year of a site."""
    hundredths = lambda c: F.floor(F.col(c) * 100 + 0.5)
    price, discount, tax = (hundredths(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
    total = lambda amount: (F.sum(price * amount) / F.lit(10000.0))
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("reading_date"))
        .agg(
            total(F.lit(100)).alias("generation_wh"),
            total(F.lit(100) - discount + tax).alias("consumption_wh"),
            total(F.lit(100) - discount).alias("self_consumption_wh"),
            total(discount).alias("grid_export_wh"),
            total(tax).alias("grid_import_wh"),
        )
    )
    site = F.col("k").cast("string")
    return daily.select(
        F.concat_ws("_", site, F.year("reading_date").cast("string")).alias("source_id"),
        site.alias("site_id"),
        "reading_date",
        *S.MEASURES,
    )


READINGS = """
readings AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '_' || CAST(year(CAST(l_shipdate AS DATE)) AS VARCHAR) AS source_id,
    CAST(l_suppkey AS VARCHAR) AS site_id, CAST(l_shipdate AS DATE) AS reading_date,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS generation_wh,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(18,2))+CAST(l_tax AS DECIMAL(18,2)))) AS DOUBLE) AS consumption_wh,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS self_consumption_wh,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS grid_export_wh,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS grid_import_wh
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""


def _phase() -> Column:
    return (F.col("site_id").cast("int") + F.dayofmonth("reading_date")) % 11


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with outages, weak generation and poor efficiency on some days of every site."""
    phase = _phase()
    g = F.when(phase == 0, F.lit(0.0)).when(phase == 1, F.col("generation_wh") * 0.25).otherwise(F.col("generation_wh"))
    a = (
        F.when(phase == 0, F.lit(0.0))
        .when(phase == 1, F.col("self_consumption_wh") * 0.25)
        .when(phase == 2, F.col("self_consumption_wh") * 0.375)
        .otherwise(F.col("self_consumption_wh"))
    )
    return readings(spark, sf_dir).withColumns({"generation_wh": g, "self_consumption_wh": a})


STRESSED = READINGS + """,
stressed AS (
  SELECT source_id, site_id, reading_date,
    CASE phase WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN generation_wh * 0.25::DOUBLE ELSE generation_wh END AS generation_wh,
    consumption_wh,
    CASE phase WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN self_consumption_wh * 0.25::DOUBLE
      WHEN 2 THEN self_consumption_wh * 0.375::DOUBLE ELSE self_consumption_wh END AS self_consumption_wh,
    grid_export_wh, grid_import_wh
  FROM (SELECT *, (CAST(site_id AS INTEGER) + day(reading_date)) % 11 AS phase FROM readings)
)"""


def with_score(df: DataFrame) -> DataFrame:
    """A deterministic stand-in for the forest's score, and the decision on it."""
    ratio = (F.col("grid_export_wh") + F.col("grid_import_wh") * 3.0) / (
        F.col("self_consumption_wh") + F.col("grid_export_wh") + 1.0
    )
    score = -F.round(ratio * 2.5 + 1e-9, 4)
    return df.withColumn("score", score).withColumn("is_anomaly", score < F.lit(ANOMALY_BELOW))


def _scored_sql(source: str, name: str) -> str:
    return f""",
{name} AS (
  SELECT *, score < {ANOMALY_BELOW}::DOUBLE AS is_anomaly FROM (
    SELECT *, -round((grid_export_wh + grid_import_wh * 3.0::DOUBLE)
      / (self_consumption_wh + grid_export_wh + 1.0::DOUBLE) * 2.5::DOUBLE + 1e-9::DOUBLE, 4) AS score FROM {source})
)"""


SCORED = READINGS + _scored_sql("readings", "scored")
STRESSED_SCORED = STRESSED + _scored_sql("stressed", "scored")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(readings(spark, sf_dir))


def stressed_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(stressed(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text cells: hundredths as digits, some cells unreadable, dates in two formats."""
    phase = _phase()
    date = F.col("reading_date")
    digits = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    return readings(spark, sf_dir).select(
        "source_id",
        "site_id",
        "reading_date",
        F.when(phase == 3, F.lit("n/d")).when(phase == 4, F.lit("")).otherwise(digits("generation_wh")).alias("generation"),
        F.when(phase == 5, F.lit("-- ")).otherwise(digits("consumption_wh")).alias("consumption"),
        F.when(phase == 6, F.lit("31.02.x"))
        .when(phase == 7, F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.date_format(date, "dd.MM.yyyy"))
        .alias("fecha"),
        F.concat(
            F.lit("/data/site files/"),
            F.when(phase == 0, F.lit("datos_energia_")).when(phase == 1, F.lit("datos_")).otherwise(F.lit("")),
            F.lit("22_10_SITIO_"), F.col("site_id"), F.lit("_01012023-01012024.csv"),
        ).alias("path"),
    )


TEXTS = READINGS + """,
texts AS (
  SELECT source_id, site_id, reading_date,
    CASE WHEN phase = 3 THEN 'n/d' WHEN phase = 4 THEN '' ELSE CAST(CAST(round(generation_wh*100) AS BIGINT) AS VARCHAR) END AS generation,
    CASE WHEN phase = 5 THEN '-- ' ELSE CAST(CAST(round(consumption_wh*100) AS BIGINT) AS VARCHAR) END AS consumption,
    CASE WHEN phase = 6 THEN '31.02.x' WHEN phase = 7 THEN strftime(reading_date, '%Y-%m-%d')
      ELSE strftime(reading_date, '%d.%m.%Y') END AS fecha,
    '/data/site files/' || CASE WHEN phase = 0 THEN 'datos_energia_' WHEN phase = 1 THEN 'datos_' ELSE '' END
      || '22_10_SITIO_' || site_id || '_01012023-01012024.csv' AS path
  FROM (SELECT *, (CAST(site_id AS INTEGER) + day(reading_date)) % 11 AS phase FROM readings)
)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from the events: the user is the site, the value gives the score."""
    score = -F.round(F.col("value") / 200.0, 5)
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("SITIO_"), F.col("user_id").cast("string")).alias("empresa"),
        score.alias("score"),
        F.when(score < -0.5, S.CRITICAL).when(score < -0.3, S.HIGH).when(score < -0.1, S.MEDIUM).otherwise(S.LOW).alias("severidad"),
    )


ALERTS = """
alerts AS (
  SELECT *, CASE WHEN score < -0.5 THEN 'CRÍTICA' WHEN score < -0.3 THEN 'ALTA' WHEN score < -0.1 THEN 'MEDIA' ELSE 'BAJA' END AS severidad
  FROM (SELECT event_id, ts AS "timestamp", 'SITIO_' || CAST(user_id AS VARCHAR) AS empresa,
    -round(value / 200.0::DOUBLE, 5) AS score FROM events)
)"""


def fleets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose source is the supplier's nation, of which there are always 25."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("fleet"))
    return readings(spark, sf_dir).join(suppliers, "site_id").join(nations, "s_nationkey").drop("s_nationkey")


FLEETS = READINGS + """,
fleets AS (
  SELECT r.*, n.n_name AS fleet FROM readings r
  JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = r.site_id JOIN nation n ON n.n_nationkey = s.s_nationkey
)"""


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by timestamp from the events; a site's series has no daily bound."""
    k = F.col("event_id") % 10
    g = F.when(k == 9, F.lit(0.0)).otherwise(F.round(F.col("value") * 100))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("site_id"),
        F.col("ts").cast("timestamp").alias("reading_ts"),
        "event_id",
        g.alias("generation_wh"),
        (F.lit(50.0) + (F.col("event_id") * 37 % 1000)).alias("consumption_wh"),
        (g * k / F.lit(10.0)).alias("self_consumption_wh"),
    )


EVENT_READINGS = """
event_readings AS (
  SELECT site_id, reading_ts, event_id, generation_wh, consumption_wh,
    generation_wh * CAST(event_id % 10 AS DOUBLE) / 10.0::DOUBLE AS self_consumption_wh
  FROM (SELECT CAST(user_id AS VARCHAR) AS site_id, ts AS reading_ts, event_id,
    CASE WHEN event_id % 10 = 9 THEN 0.0::DOUBLE ELSE round(value * 100) END AS generation_wh,
    50.0::DOUBLE + (event_id * 37 % 1000) AS consumption_wh FROM events)
)"""


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round the given columns and clear the sign of zero.

    The tiny shift keeps values that lie exactly between two roundings on one side in both engines.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-9), digits) + F.lit(0.0) for c in columns})


def r(expression: str, name: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"round({expression} + 1e-9::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"
