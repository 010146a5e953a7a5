"""Registry of the queries the driver runs, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from sunledger.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``; ``sql`` yields the same rows on the same tables."""

    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return _dates_as_text(run(spark, sf_dir))

        QUERIES[key] = prepared
        if sql is not None:
            ORACLES[key] = sql
        return run

    return register


def _dates_as_text(df: DataFrame) -> DataFrame:
    dates = [f.name for f in df.schema if isinstance(f.dataType, DateType)]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})
