"""Reading files that keep arriving in a folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunledger.plans.jobs import raise_alerts
from sunledger.plans.model import AnomalyModel
from sunledger.sources.readings import cells_by_name, typed_readings


def readings_stream(spark: SparkSession, folder: str, pattern: str = "*.csv", max_files: int = 1000) -> DataFrame:
    """The typed readings of each new file that matches ``pattern``, at most ``max_files`` per batch; each file by its
    own header, as in a batch job. A file that Spark splits fails the stream: its header is in another split."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .text(folder)
    )
    cells = cells_by_name(lines)
    text = "a file is larger than spark.sql.files.openCostInBytes and was split: read it by a batch job or raise that setting: "
    whole = F.coalesce("line", "header").isNull()
    refused = F.raise_error(F.concat(F.lit(text), F.col("path"))).cast("boolean")
    return typed_readings(cells.where(F.when(whole, F.lit(True)).otherwise(refused)).drop("line", "header"))


def monitor_folder(
    readings: DataFrame,
    model: AnomalyModel,
    alerts_path: str,
    critical_path: str,
    checkpoint: str,
    interval_seconds: int = 60,
    on_alerts: Callable[[DataFrame], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Score every reading of a stream (``readings_stream``) once and store its alerts.

    The checkpoint remembers the files already read, across restarts. A batch that is replayed after
    a failure overwrites its own folder, which carries the checkpoint's name, so no alert is stored
    twice and no other run's alerts are touched. ``once`` stops when the files present now are done.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def handle(batch: DataFrame, batch_id: int) -> None:
        raise_alerts(model, batch, alerts_path, critical_path, f"{name}-{batch_id}", None, on_alerts)

    writer = readings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{interval_seconds} seconds"}
    return writer.trigger(**trigger).start()
