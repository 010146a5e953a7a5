"""Unions, duplicate removal and key-set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_KEY = ["site_id", "reading_date"]


def union_sites(tables: list[DataFrame]) -> DataFrame:
    """Union by column name; a column a table lacks is null there. Copies are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_sites(df: DataFrame, site: str = "source_id") -> DataFrame:
    return df.select(site).distinct()


def drop_reloaded(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Readings loaded twice, once: rows that agree in every column. Copies fold map-side.

    Rows with a null among ``keys`` (source and date) are left alone: nothing tells them apart. Files
    named twice are read once to begin with (``read_readings``), so different readings of one date stay.
    """
    keys = keys or ["source_id", "reading_date"]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).dropDuplicates().unionAll(df.where(~known))


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def unprocessed(df: DataFrame, ledger: DataFrame, on: list[str]) -> DataFrame:
    """Inputs the ledger of processed ones does not list yet."""
    return drop_matching(df, ledger, on)


def true_positives(predicted: DataFrame, known: DataFrame, on: list[str] | None = None) -> DataFrame:
    on = on or ROW_KEY
    return keep_matching(predicted.select(*on).distinct(), known, on)


def false_positives(predicted: DataFrame, known: DataFrame, on: list[str] | None = None) -> DataFrame:
    on = on or ROW_KEY
    return drop_matching(predicted.select(*on).distinct(), known, on)


def false_negatives(predicted: DataFrame, known: DataFrame, on: list[str] | None = None) -> DataFrame:
    on = on or ROW_KEY
    return drop_matching(known.select(*on).distinct(), predicted, on)


def confusion(predicted: DataFrame, known: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 as one row; a ratio without a denominator is 0.

    Both key sets go through one aggregate on the key, so one shuffle yields all three counts.
    """
    on = on or ROW_KEY
    tagged = predicted.select(*on, F.lit(1).alias("p"), F.lit(0).alias("k")).unionAll(
        known.select(*on, F.lit(0).alias("p"), F.lit(1).alias("k"))
    )
    per_key = tagged.groupBy(*on).agg(F.max("p").alias("p"), F.max("k").alias("k"))
    p, k = F.col("p") == 1, F.col("k") == 1
    counts = per_key.agg(
        F.count_if(p & k).alias("true_positives"),
        F.count_if(p & ~k).alias("false_positives"),
        F.count_if(~p & k).alias("false_negatives"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives"))
    zero = F.lit(0.0)
    with_ratios = counts.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), zero)
    return with_ratios.withColumn("f1_score", f1)
