"""Connected components of a stored edge table, without collecting it anywhere.

A star, the usual shape of a group of near copies, ends after two rounds. Rounds are written as Parquet,
which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; long, not null) -> (node, label): the smallest node reachable. Nodes without edges are left out.

    Alternates the large-star and small-star steps, which keep the number of edges and reach a star per component in a logarithmic number
    of rounds. Every step combines map-side before the shuffle by node, so a hub costs one row per task.
    """
    stars = materialize(_star(edges.where("a <> b").select("a", "b").distinct(), True), "edges")
    sums = _sums(stars)
    while True:
        stars = materialize(_star(_star(stars, False), True), "edges")
        before, sums = sums, _sums(stars)
        if sums == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())


def _sums(edges: DataFrame) -> tuple:
    """Tells whether a round changed the edges: their number, and two hashes over all of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: join every larger neighbour of a node to the smallest one in reach; small star: every smaller neighbour and the node itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A stored table: Spark sees its size and either broadcasts it or joins by sort and splits a hub's edges.
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
