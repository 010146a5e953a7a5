"""Exact histogram of encoded lengths with suffix sums.

Documents are aggregated by their number of tokens. Sums over all longer documents then answer, for any
context limit, how many tokens there are, how many remain when every document is cut at the limit, and
where the quantiles lie. Lengths are summed in blocks first, so no task orders all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunledger.storage import materialize

from . import tokens

BLOCK = 128


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """One row per length: length, n_docs (long). Null text has length 0; repeated rows count as often as they occur."""
    counted = tokens.with_token_count(docs.select("text"), "text", "token", path)
    return counted.groupBy(F.col("token.n").alias("length")).agg(F.count("*").alias("n_docs"))


def with_suffix_sums(table: DataFrame) -> DataFrame:
    """Histogram rows with n_tokens, docs_at_least, tokens_at_least (both from this length on), truncated_total (tokens of
    all documents cut at this length) and share_at_most (of documents). An empty table stays empty."""
    table = materialize(table, "histogram")  # read three times; as small as the number of different lengths
    table = table.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    later = Window.orderBy(F.col("block").desc())  # one row per block of lengths
    blocks = (
        table.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
        .withColumn("docs_after", F.sum("d").over(later) - F.col("d"))
        .withColumn("tokens_after", F.sum("t").over(later) - F.col("t"))
    )
    total = blocks.agg(F.sum("d").alias("docs"), F.sum("t").alias("tokens"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    summed = (
        table.join(blocks.drop("d", "t"), "block").crossJoin(F.broadcast(total))  # total is one row
        .withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("docs_after"))
        .withColumn("tokens_at_least", F.sum("n_tokens").over(within) + F.col("tokens_after"))
    )
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("share_at_most"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: n_cut (documents longer than it), total (all tokens), truncated_total, tokens_lost."""
    limit = F.explode(F.array(*(F.lit(int(n)).cast("long") for n in limits))).alias("context_limit")
    kept = F.sum(F.col("n_docs") * F.least("length", "context_limit"))
    all_tokens = F.sum(F.col("n_docs") * F.col("length"))
    return (
        table.select("length", "n_docs", limit).groupBy("context_limit")
        .agg(
            F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("n_cut"),
            all_tokens.alias("total"), kept.alias("truncated_total"), (all_tokens - kept).alias("tokens_lost"),
        )
    )


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the smallest length that at least this share of documents does not exceed."""
    share = F.explode(F.array(*(F.lit(float(q)) for q in shares))).alias("share")
    return (
        summed.select("length", "share_at_most", share)
        .where(F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
    )
