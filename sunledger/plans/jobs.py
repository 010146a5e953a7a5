"""The batch jobs: train on many sites, score, report, alert and predict problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions.readings import with_default_site
from sunledger.operators import alerts as A
from sunledger.operators import reports, trends
from sunledger.plans.model import AnomalyModel, train
from sunledger.sinks import tables
from sunledger.sinks.stores import Store
from sunledger.operators.order_statistics import top_k_per_group
from sunledger.sources.readings import read_readings
from sunledger.storage import materialize


def train_from_files(
    spark: SparkSession,
    paths: list[str],
    contamination: float = S.CONTAMINATION,
    normalization: str = "global",
    save_to: str | None = None,
) -> AnomalyModel | None:
    """Train one model on the files of many sites, every row of each, and store it with the site profiles."""
    readings = materialize(read_readings(spark, paths), "readings")
    if readings.isEmpty():
        return None
    model = train(readings, contamination=contamination, normalization=normalization)
    if save_to:
        model.save(save_to)
        tables.write_profiles_json(model.profiles, f"{save_to}/profiles_json")
    return model


def score_table(model: AnomalyModel, readings: DataFrame, site: str | None = None) -> DataFrame:
    """Score a table; ``site`` names the source where the table has no source column."""
    if site is not None:
        readings = with_default_site(readings, site)
    return model.get_anomalies(readings)


def score_files(
    spark: SparkSession, model: AnomalyModel, paths: str | list[str], output: str | None = None, site: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score reading files: all scored rows, the summary, and the ten worst anomalies."""
    readings = read_readings(spark, paths)
    if site is not None:
        readings = readings.withColumn("source_id", F.lit(site))
    scored = model.get_anomalies(readings)
    if output:
        tables.write_csv(tables.with_source_headers(scored), output)
    return scored, reports.global_summary(scored), reports.worst_anomalies(scored)


def alert_files(
    spark: SparkSession,
    model: AnomalyModel,
    paths: str | list[str],
    alerts_path: str,
    critical_path: str,
    run_id: str,
    site: str | None = None,
    output: str | None = None,
    at: Column | None = None,
    on_alerts: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Score files, store an alert per anomaly, and hand the stored alerts to the caller's hook.

    Alerts are added to the stores under ``run_id``: another run adds to them, the same run repeated
    replaces its own. ``site`` names the source of all rows; ``output`` takes the scored rows as CSV.
    """
    readings = read_readings(spark, paths)
    if site is not None:
        readings = readings.withColumn("source_id", F.lit(site))
    scored = model.predict(readings)
    if output:
        scored = materialize(scored, "scored")
        tables.write_csv(tables.with_source_headers(scored), output)
    return _store_alerts(scored, alerts_path, critical_path, run_id, at, on_alerts)


def raise_alerts(
    model: AnomalyModel,
    readings: DataFrame,
    alerts_path: str,
    critical_path: str,
    run_id: str,
    at: Column | None = None,
    on_alerts: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Alerts of one batch of readings, stored under the batch's id."""
    return _store_alerts(model.predict(readings), alerts_path, critical_path, run_id, at, on_alerts)


def _store_alerts(scored, alerts_path, critical_path, run_id, at, on_alerts) -> DataFrame:
    stored = tables.fan_out_alerts(A.score_alerts(A.alert_gate(scored), at), alerts_path, critical_path, run_id)
    if on_alerts is not None:
        on_alerts(stored)
    return stored


def predict_problems(scored: DataFrame) -> DataFrame:
    """Trends, risk and problem classification of scored readings, one reading per site and day."""
    return A.classify(trends.analyze_trends(scored))


def problem_report(model: AnomalyModel, readings: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Extended alerts of the readings that need one, and the summary of all readings."""
    scored = model.predict(trends.one_reading_per_day(readings))
    analyzed = materialize(predict_problems(scored), "problems")
    return A.problem_alerts(A.prediction_gate(analyzed), at), reports.global_summary(analyzed)


def problem_files(
    spark: SparkSession,
    model: AnomalyModel,
    paths: str | list[str],
    history_path: str,
    alerts_path: str,
    critical_path: str,
    run_id: str,
    site: str | None = None,
    at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Predict problems of new files with the stored history of their sites.

    The history's last days of each site go before the new readings, so a run with one new day per site
    sees the same trends as one run over everything. New readings are added to the history under
    ``run_id``, from which they are analysed, and alerted on; a repeated run replaces its own part and
    does not see it, so a run that failed in between is repeated. Returns the stored alerts and the
    summary of the new readings.
    """
    readings = read_readings(spark, paths)
    if site is not None:
        readings = readings.withColumn("site_id", F.lit(site))
    new = tables.stored_batch(model.predict(trends.one_reading_per_day(readings)), history_path, run_id)
    seen = Store(spark, history_path).read()
    if seen is not None:
        seen = seen.where(F.col("run") != run_id).drop("run")
        # Only what a trend can reach back to: a bounded number of days before the first new one of each site.
        first = new.groupBy("site_id").agg(F.min("reading_date").alias("_first"))
        seen = seen.join(materialize(first, "first-days"), "site_id").where(F.col("reading_date") < F.col("_first")).drop("_first")
        seen = top_k_per_group(seen, ["site_id"], [F.desc("reading_date")], S.HISTORY_ROWS, salts=0)
    both = new.withColumn("_new", F.lit(True))
    if seen is not None:
        both = both.unionByName(seen.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    analyzed = predict_problems(both).where("_new").drop("_new")
    alerts = A.problem_alerts(A.prediction_gate(analyzed), at)
    stored = tables.fan_out_alerts(alerts, alerts_path, critical_path, run_id)
    return stored, materialize(reports.global_summary(new), "summary")


def fleet_report(scored: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the multi-site report. ``scored`` is read by several of them: pass a stored table."""
    per_site = materialize(reports.site_report(scored), "sites")
    return {
        "rows_per_site": reports.shares(per_site),
        "anomalies_per_site": per_site.where("anomalies > 0").select("source_id", "anomalies"),
        "site_report": per_site,
        "summary": reports.global_summary(scored),
        "executive_summary": reports.executive_summary(scored),
        "score_histogram": reports.score_histogram(scored),
        "threshold_marker": reports.anomaly_threshold_marker(scored),
        "box_plots": reports.box_plots(scored),
        "top_by_records": reports.top_n(per_site, [F.desc("records"), F.asc("source_id")]),
        "top_by_anomalies": reports.top_n(per_site, [F.desc("anomalies"), F.asc("source_id")]),
        "lowest_mean_scores": reports.top_n(per_site, [F.asc("mean_score"), F.asc("source_id")]),
    }
