"""Aggregates and report tables over readings and scored readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions.severity import rate_band
from sunledger.operators.order_statistics import exact_percentiles, histogram, percentile_row

SITE = "source_id"


def rows_per_site(df: DataFrame, site: str = SITE) -> DataFrame:
    """Rows of each site and their share of all rows, in percent."""
    return shares(df.groupBy(site).agg(F.count(F.lit(1)).alias("records")), site)


def shares(counts: DataFrame, site: str = SITE) -> DataFrame:
    """Each site's ``records`` and their share of all of them, in percent."""
    # The total is a second, one-row aggregate of the counts: a window would gather all sites in a task.
    total = counts.agg(F.sum("records").alias("_total"))
    share = F.col("records").cast("double") / F.col("_total") * 100
    return counts.crossJoin(F.broadcast(total)).select(site, "records", share.alias("share_percent"))


def site_profiles(df: DataFrame, site: str = SITE) -> DataFrame:
    """Records, means and sample standard deviations of generation and consumption per site."""
    return df.groupBy(site).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("generation_wh").alias("mean_generation"),
        F.avg("consumption_wh").alias("mean_consumption"),
        F.stddev_samp("generation_wh").alias("std_generation"),
        F.stddev_samp("consumption_wh").alias("std_consumption"),
    )


def site_report(scored: DataFrame, site: str = SITE) -> DataFrame:
    """Records, anomalies, anomaly rate with its traffic light, and means per site."""
    rate = F.avg(F.col("is_anomaly").cast("int")) * 100
    return scored.groupBy(site).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("is_anomaly").alias("anomalies"),
        rate.alias("anomaly_rate"),
        rate_band(rate).alias("rate_band"),
        F.avg("score").alias("mean_score"),
        F.avg("generation_wh").alias("mean_generation"),
        F.avg("consumption_wh").alias("mean_consumption"),
    )


def anomalies_per_site(scored: DataFrame, site: str = SITE) -> DataFrame:
    """Anomalies of each site that has any."""
    return scored.where("is_anomaly").groupBy(site).agg(F.count(F.lit(1)).alias("anomalies"))


def global_summary(scored: DataFrame) -> DataFrame:
    """Total, normal and anomalous rows and the anomaly share in percent."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.coalesce(F.avg(F.col("is_anomaly").cast("int")) * 100, F.lit(0.0)).alias("anomaly_percent"),
    )


def executive_summary(scored: DataFrame, site: str = SITE) -> DataFrame:
    """Fleet totals, the largest site and the site with most anomalies (ties: first by name)."""
    per_site = scored.groupBy(site).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("is_anomaly").alias("anomalies")
    )
    largest = F.min_by(F.struct(site, "records"), F.struct(-F.col("records"), F.col(site)))
    worst = F.min_by(F.struct(site, "anomalies"), F.struct(-F.col("anomalies"), F.col(site)))
    return per_site.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum("records").alias("records"),
        F.sum("anomalies").alias("anomalies"),
        (F.sum("anomalies").cast("double") / F.sum("records") * 100).alias("anomaly_rate"),
        largest.alias("_largest"),
        worst.alias("_worst"),
    ).select(
        "sites", "records", "anomalies", "anomaly_rate",
        F.col("_largest")[site].alias("largest_site"),
        F.col("_largest.records").alias("largest_site_records"),
        F.col("_worst")[site].alias("worst_site"),
        F.col("_worst.anomalies").alias("worst_site_anomalies"),
    )


def validation_stats(scored: DataFrame) -> DataFrame:
    """Samples, detected anomalies, their rate, and their mean score (0 without any)."""
    flag = F.col("is_anomaly").cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.sum(flag), F.lit(0)).alias("anomalies_detected"),
        F.coalesce(F.avg(flag), F.lit(0.0)).alias("anomaly_rate"),
        F.coalesce(F.avg(F.when(F.col("is_anomaly"), F.col("score"))), F.lit(0.0)).alias("mean_anomaly_score"),
    )


def anomaly_threshold_marker(scored: DataFrame) -> DataFrame:
    """The lowest score among the anomalies."""
    return scored.agg(F.min(F.when(F.col("is_anomaly"), F.col("score"))).alias("threshold_marker"))


def most_frequent_sites(df: DataFrame, n: int = 10, site: str = SITE) -> DataFrame:
    """The ``n`` sites with most rows; ties go by name."""
    return top_n(df.groupBy(site).agg(F.count(F.lit(1)).alias("records")), [F.desc("records"), F.asc(site)], n)


def top_n(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)


def worst_anomalies(scored: DataFrame, n: int = 10, tie_break: list[str] | None = None) -> DataFrame:
    """The ``n`` anomalies with the lowest scores."""
    return top_n(scored.where("is_anomaly"), [F.asc("score"), *[F.asc(c) for c in tie_break or [SITE, "reading_date"]]], n)


def anomalies_by_score(scored: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """All anomalies, the most anomalous first."""
    return scored.where("is_anomaly").orderBy("score", *(tie_break or [SITE, "reading_date"]))


def score_series(scored: DataFrame) -> DataFrame:
    """Scores with their anomaly marks in date order (the site completes the order and splits busy dates)."""
    return scored.select("reading_date", SITE, "score", "is_anomaly").orderBy("reading_date", SITE)


def box_plots(scored: DataFrame, n: int = 10, site: str = SITE) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of the scores of the ``n`` sites with most rows."""
    kept = scored.join(F.broadcast(most_frequent_sites(scored, n, site).select(site)), site, "left_semi")
    quartiles = (
        exact_percentiles(kept, ["score"], [0.25, 0.5, 0.75], by=[site])
        .groupBy(site)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    score = F.col("score")
    # Ten rows at most: one per kept site.
    return (
        kept.join(F.broadcast(quartiles), site)
        .groupBy(site, "q1", "median", "q3")
        .agg(
            F.min(F.when(score >= F.col("q1") - reach, score)).alias("lower_whisker"),
            F.max(F.when(score <= F.col("q3") + reach, score)).alias("upper_whisker"),
            F.count_if((score < F.col("q1") - reach) | (score > F.col("q3") + reach)).alias("outliers"),
        )
    )


def batch_cut(scored: DataFrame, percentile: float = S.SEVERITY_PERCENTILE) -> DataFrame:
    """The batch's own severity cut as one row, column ``severity_cut``."""
    return percentile_row(scored, "score", {"severity_cut": percentile})


def score_histogram(scored: DataFrame) -> DataFrame:
    """Fifty equal-width bins of the score."""
    return histogram(scored, "score")
