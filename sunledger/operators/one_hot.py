"""One-hot sources as sparse vectors, for fleets whose sources are too many for a column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.operators.order_statistics import with_position, with_scalar


def source_index(df: DataFrame, source: str = "source_id") -> DataFrame:
    """The distinct sources with their ``place`` (0-based, by name) in a one-hot block, and the block's ``width``.

    Null is no source. A range-partitioned sort numbers them: neither the driver nor one task holds the table.
    """
    known = df.where(F.col(source).isNotNull()).select(source).distinct()
    placed = with_position(known, [source]).withColumnRenamed("position", "place")
    return with_scalar(placed, placed.agg(F.count(F.lit(1)).alias("width")))


def with_one_hot(df: DataFrame, index: DataFrame, source: str = "source_id", name: str = "one_hot") -> DataFrame:
    """``df`` with a sparse vector ``name``: a struct of ``width``, ``places`` and ``values``.

    A source that ``index`` lacks, or null, has no places. The width is that of ``index``, 0 if it is empty. The lookup
    is a join that Catalyst broadcasts by size only; beyond it, adaptive execution splits a hot source.
    """
    place, width = f"_{name}_place", f"_{name}_width"
    placed = df.join(index.select(source, F.col("place").alias(place)), source, "left")
    held = with_scalar(placed, index.agg(F.coalesce(F.max("width"), F.lit(0)).alias(width)))
    known = F.col(place).isNotNull()
    vector = F.struct(
        F.col(width).alias("width"),
        F.when(known, F.array(place)).otherwise(F.array().cast("array<bigint>")).alias("places"),
        F.when(known, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )
    return held.withColumn(name, vector).select(*df.columns, name)


def dense(one_hot: str = "one_hot"):
    """The sparse vector as an array of 0 and 1, for narrow blocks only."""
    vector = F.col(one_hot)
    places = F.sequence(F.lit(0).cast("bigint"), vector["width"] - 1)
    laid = F.transform(places, lambda i: F.array_contains(vector["places"], i).cast("int"))
    return F.when(vector["width"] > 0, laid).otherwise(F.array().cast("array<int>"))
