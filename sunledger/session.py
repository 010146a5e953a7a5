"""Session defaults. A session that already exists is used as it is."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot site's partition when a lookup is too large to be broadcast.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "sunledger", **overrides: str) -> SparkSession:
    """Get or create a session; cluster settings (master, memory, partitions) stay the cluster's."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application (like ``--py-files``)."""
    context = spark.sparkContext
    if getattr(context, "_sunledger_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sunledger-package-")
    archive = shutil.make_archive(os.path.join(folder, "sunledger"), "zip", root, "sunledger")
    context.addPyFile(archive)
    context._sunledger_shipped = True
