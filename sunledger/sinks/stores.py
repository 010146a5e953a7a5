"""Parquet stores that grow run by run and can be compacted while others read them.

Every run is a folder ``run=<id>``. A compaction writes all rows, or the newest ones, into a snapshot and then
publishes a manifest that names the snapshot and the runs it has absorbed. A reader follows the newest manifest:
its snapshot and all runs that it does not name. What a manifest makes superfluous is deleted by the compaction
after the next one, so whoever began to read before a compaction ends undisturbed.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.operators.order_statistics import newest
from sunledger.storage import Versions, delete_path, folder_names, path_exists

RUN = "run"
#: Stores stay and grow, so they are packed tighter than Spark's default: by a fifth to a quarter for alerts and readings.
COMPRESSION = "zstd"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Versions(spark, f"{self.path}/_manifests")

    def write(self, df: DataFrame, run_id: str) -> str:
        """Store a run in its own folder; the same run repeated replaces its rows, even those of a snapshot."""
        if not re.fullmatch(r"[\w.-]+", run_id):
            raise ValueError(f"a run's id names a folder: letters, digits, '_', '-' and '.' only, not {run_id!r}")
        folder = f"{RUN}={run_id}"
        number, manifest = self._manifest()
        if folder in manifest["absorbed"]:
            left = [f for f in manifest["absorbed"] if f != folder]
            self.manifests.publish(number + 1, {**manifest, "absorbed": left})
        target = f"{self.path}/{folder}"
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(target)
        return target

    def read(self) -> DataFrame | None:
        """All rows with the id of their run (``run``, string); None for a store without any run."""
        manifest = self._manifest()[1]
        return self._rows(manifest, self._live(manifest))

    def compact(self, keep: int | None = None, order: list[str] | None = None, files: int = 4) -> None:
        """Put everything into a snapshot of at most ``files`` files; with ``keep`` only the newest rows by ``order``.

        Runs stored meanwhile are not touched. Two compactions at once: the one that publishes last fails and
        changes nothing.
        """
        number, manifest = self._manifest()
        live = self._live(manifest)
        rows = self._rows(manifest, live)
        if rows is None:
            return
        if keep is not None:
            rows = newest(rows, order or [], keep)
        snapshot = f"_snapshots/{number + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows.coalesce(files).write.option("compression", COMPRESSION).parquet(f"{self.path}/{snapshot}")
        before = [manifest["snapshot"]] if manifest["snapshot"] else []
        self.manifests.publish(number + 1, {"snapshot": snapshot, "absorbed": live, "superseded": before})
        for folder in [*manifest["absorbed"], *manifest["superseded"]]:
            delete_path(self.spark, f"{self.path}/{folder}")

    def _manifest(self) -> tuple[int, dict]:
        return self.manifests.latest() or (0, {"snapshot": None, "absorbed": [], "superseded": []})

    def _live(self, manifest: dict) -> list[str]:
        """Folders of finished runs that the snapshot does not hold."""
        named = set(manifest["absorbed"])
        found = [f for f in folder_names(self.spark, self.path) if f.startswith(f"{RUN}=") and f not in named]
        return sorted(f for f in found if path_exists(self.spark, f"{self.path}/{f}/_SUCCESS"))

    def _rows(self, manifest: dict, live: list[str]) -> DataFrame | None:
        parts = []
        # The id comes from the path: Spark would take ids of digits for numbers.
        run = F.regexp_extract(F.col("_metadata.file_path"), f"/{RUN}=([^/]+)/", 1)
        if live:
            stored = self.spark.read.parquet(*[f"{self.path}/{f}" for f in live])
            parts.append(stored.select(*[c for c in stored.columns if c != RUN], run.alias(RUN)))
        if manifest["snapshot"]:
            held = self.spark.read.parquet(f"{self.path}/{manifest['snapshot']}")
            # A run that was stored again since takes the place of its rows in the snapshot.
            parts.append(held.where(~F.col(RUN).isin([f.removeprefix(f"{RUN}=") for f in live])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
