"""Trends and problems of readings as they arrive, with the last readings of each site kept between batches.

A micro-batch is handled by the batch operators: the readings remembered of each site go before the new ones,
and the same windows give the trends. So a site's readings are sorted by Spark, spill like any sort, and never
pass through a Python worker, however many of them one batch holds. What is remembered is seven readings a site,
stored under the stream's checkpoint: a batch that is replayed reads the state before it and writes the same again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunledger import schema as S
from sunledger.operators import alerts as A
from sunledger.operators.order_statistics import top_k_per_group
from sunledger.operators.trends import analyze_trends
from sunledger.plans.jobs import predict_problems
from sunledger.plans.model import AnomalyModel
from sunledger.sinks import tables
from sunledger.storage import delete_path, materialize

_MEASURES = ["generation_wh", "consumption_wh", "self_consumption_wh"]
_REMEMBERED = "site_id string, reading_date date, generation_wh double, consumption_wh double, self_consumption_wh double, batch long"
#: Every so many batches the readings of all sites are stored anew, and only those of the batch's own sites in between.
FULL_EVERY = 16


class LastReadings:
    """The last seven readings of each site after each batch of one stream.

    A batch stores a folder of its own, ``batch=<id>``; only Spark's committed batches are ever followed by another
    one. Folders that no replay can ask for any more are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """What is known of each site before a batch (ids count from 0)."""
        if batch_id == 0:
            return self.spark.createDataFrame([], _REMEMBERED).drop("batch")
        full = (batch_id - 1) // FULL_EVERY * FULL_EVERY
        parts = [self._folder(i) for i in range(full, batch_id)]
        stored = self.spark.read.schema(_REMEMBERED).option("basePath", self.path).parquet(*parts)
        # At most FULL_EVERY times seven rows a site.
        latest = F.max("batch").over(Window.partitionBy("site_id"))
        return stored.withColumn("_latest", latest).where("batch = _latest").drop("batch", "_latest")

    def commit(self, batch_id: int, new: DataFrame, remembered: DataFrame) -> None:
        """Store the state after a batch. ``new``: its readings in order, as they were stored. ``remembered``: that of all sites before."""
        if batch_id % FULL_EVERY:
            remembered = of_sites_in(new, remembered)
        columns = ["site_id", "reading_date", *_MEASURES]
        seen = new.select(*columns).unionByName(remembered.select(*columns))
        rows = top_k_per_group(seen, ["site_id"], [F.desc("reading_date")], S.HISTORY_ROWS, salts=0)
        rows.write.mode("overwrite").parquet(self._folder(batch_id))
        if batch_id % FULL_EVERY == 0:
            for old in range(max(0, batch_id - 2 * FULL_EVERY), batch_id - FULL_EVERY):
                delete_path(self.spark, self._folder(old))


def of_sites_in(new: DataFrame, remembered: DataFrame) -> DataFrame:
    """What is remembered of the sites that ``new`` has."""
    sites = new.select("site_id").distinct()
    return remembered.join(sites, remembered["site_id"].eqNullSafe(sites["site_id"]), "left_semi")


def with_remembered(new: DataFrame, remembered: DataFrame) -> DataFrame:
    """The readings of a batch in order (flag ``_new``) and those remembered."""
    flagged = remembered.withColumn("_new", F.lit(False))
    return new.withColumn("_new", F.lit(True)).unionByName(flagged, allowMissingColumns=True)


def arrivals(batch: DataFrame, remembered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readings of a batch in order, and the late ones.

    A reading without a date, not later than its site's newest remembered one, or of a day that the batch has
    twice, is late; of a day's readings the smallest one is in order. Only sites and days are shuffled to find such days,
    combined in every task, and only the readings of those days are stored; all others pass as they are.
    """
    rest = [c for c in batch.columns if c not in ("site_id", "reading_date")]
    days = _late_days(batch, remembered)
    same = F.col("site_id").eqNullSafe(F.col("_site")) & F.col("reading_date").eqNullSafe(F.col("_day"))
    rows = materialize(batch.join(days, same).withColumn("_id", F.monotonically_increasing_id()), "late-rows")
    first = rows.where("_kept").groupBy("site_id", "reading_date").agg(F.min(F.struct(*rest, "_id")).alias("_row"))
    ordered = batch.join(days, same, "left_anti").select("site_id", "reading_date", *rest)
    late = rows.join(first.select("_row._id"), "_id", "left_anti").select(*batch.columns)
    return ordered.unionByName(first.select("site_id", "reading_date", *[f"_row.{c}" for c in rest])), late


def _late_days(batch: DataFrame, remembered: DataFrame) -> DataFrame:
    """(_site, _day, _kept): the days of a batch with a late reading, and whether another one of them is in order. Stored."""
    days = batch.groupBy("site_id", "reading_date").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    newest = materialize(remembered.groupBy(F.col("site_id").alias("_site")).agg(F.max("reading_date").alias("_newest")), "newest")
    later = F.col("reading_date").isNotNull() & (F.col("_newest").isNull() | (F.col("reading_date") > F.col("_newest")))
    known = days.join(newest, F.col("site_id").eqNullSafe(F.col("_site")), "left").withColumn("_kept", later)
    found = known.where("_twice OR NOT _kept")
    return materialize(found.select(F.col("site_id").alias("_site"), F.col("reading_date").alias("_day"), "_kept"), "late-days")


def stream_trends(readings: DataFrame, path: str, late_path: str, checkpoint: str, interval_seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Store every reading of a stream with its trends and risk under ``path``, late ones (``arrivals``) under ``late_path``.

    A batch job over the stored readings gives the late ones their trends. ``once`` stops when what is present now
    is done.
    """

    def handle(batch: DataFrame, remembered: DataFrame, run_id: str) -> DataFrame:
        new, late = arrivals(batch.select("site_id", "reading_date", *_MEASURES), remembered)
        stored = tables.stored_batch(analyze_trends(with_remembered(new, remembered)).where("_new").drop("_new"), path, run_id)
        tables.write_batch(late, late_path, run_id)
        return stored

    return _follow(readings, handle, checkpoint, interval_seconds, once)


def stream_problems(
    readings: DataFrame,
    model: AnomalyModel,
    history_path: str,
    alerts_path: str,
    critical_path: str,
    late_path: str,
    checkpoint: str,
    interval_seconds: int = 60,
    at: Column | None = None,
    on_alerts: Callable[[DataFrame], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Score and analyse every reading as it arrives, and alert on anomalies and on future risk.

    Each batch stores its scored readings (``history_path``), late readings, extended alerts and critical alerts in
    folders of its own, which a replay overwrites; then the sites' last readings are remembered. ``on_alerts`` gets
    the stored alerts, again if the batch is replayed. Scores do not depend on the order, so late readings are stored
    with theirs, without trends.
    """

    def handle(batch: DataFrame, remembered: DataFrame, run_id: str) -> DataFrame:
        new, late = arrivals(batch, remembered)
        new = tables.stored_batch(model.predict(new), history_path, run_id)
        tables.write_batch(model.predict(late), late_path, run_id)
        analyzed = predict_problems(with_remembered(new, of_sites_in(new, remembered))).where("_new").drop("_new")
        stored = tables.fan_out_alerts(A.problem_alerts(A.prediction_gate(analyzed), at), alerts_path, critical_path, run_id)
        if on_alerts is not None:
            on_alerts(stored)
        return new

    return _follow(readings, handle, checkpoint, interval_seconds, once)


def _follow(readings: DataFrame, handle: Callable, checkpoint: str, interval_seconds: int, once: bool) -> StreamingQuery:
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    memory = f"{checkpoint.rstrip('/')}/last-readings"

    def run(batch: DataFrame, batch_id: int) -> None:
        state = LastReadings(batch.sparkSession, memory)
        remembered = state.before(batch_id)
        state.commit(batch_id, handle(batch, remembered, f"{name}-{batch_id}"), remembered)

    writer = readings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{interval_seconds} seconds"}
    return writer.trigger(**trigger).start()
