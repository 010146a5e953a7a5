"""Normalisation: fitting is an aggregate, applying is a projection.

A fitted scaler is a table with one ``<column>__center`` and ``<column>__scale`` pair per column:
one row for the whole table, or one row per source. It is written to disk, so it can be stored with
a model and Catalyst knows its size when it is joined: a small one is broadcast, a large one is
joined by sort-merge, where adaptive execution splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.operators.order_statistics import exact_percentiles
from sunledger.storage import materialize

SOURCE = "source_id"


def fit_scaler(df: DataFrame, columns: list[str], method: str = "global") -> DataFrame:
    """Centers and scales of ``columns``: ``global`` and ``per_company`` z-scores, or ``robust``."""
    if method == "global":
        return materialize(df.agg(*_moments(columns)), "scaler")
    if method == "per_company":
        return materialize(df.groupBy(SOURCE).agg(*_moments(columns)), "scaler")
    if method == "robust":
        return materialize(_quartile_scaler(df, columns), "scaler")
    raise ValueError(f"unknown normalisation: {method}")


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Scale ``columns``; rows of a source the scaler does not know keep their raw values."""
    if SOURCE in scaler.columns:
        joined = df.join(scaler, SOURCE, "left")
    else:
        joined = df.crossJoin(F.broadcast(scaler))  # one row: an ungrouped aggregate
    scaled = {f"{c}{suffix}": _scaled(c) for c in columns}
    return joined.withColumns(scaled).drop(*[c for c in scaler.columns if c != SOURCE])


def _scaled(column: str) -> Column:
    value, center, scale = F.col(column), F.col(f"{column}__center"), F.col(f"{column}__scale")
    return F.coalesce((value - center) / scale, value.cast("double"))


def _moments(columns: list[str]) -> list[Column]:
    """Mean and population standard deviation; a constant column is divided by 1."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out.append(F.avg(x).alias(f"{c}__center"))
        out.append(_nonzero(F.stddev_pop(x)).alias(f"{c}__scale"))
    return out


def _quartile_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])

    pick = lambda c, p: f"max(value) FILTER (WHERE column = '{c}' AND prob = {p}D)"
    out = []
    for c in columns:
        out.append(F.expr(pick(c, 0.5)).alias(f"{c}__center"))
        out.append(_nonzero(F.expr(f"{pick(c, 0.75)} - {pick(c, 0.25)}")).alias(f"{c}__scale"))
    return quartiles.agg(*out)


def _nonzero(scale: Column) -> Column:
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)
