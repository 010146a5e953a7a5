"""Durable intermediate tables.

Everything that is read more than once, or whose rows must not change between two passes, is
written as Parquet to the folder the session names in ``spark.checkpoint.dir``. Such a table
survives the loss of an executor, and its size on disk lets Catalyst decide by itself between a
broadcast and a sort-merge join.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is set, a local session (tests) gets a temporary one; on a cluster, where executors would
    each write to a disk of their own, the job stops.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="sunledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/sunledger/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system the path names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = file_system.globStatus(hadoop_path)
    return matches is not None and len(matches) > 0


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in file_system.listStatus(hadoop_path)]


class Versions:
    """Numbered records in a folder, one small JSON file each; the one with the highest number holds.

    A number is taken by creating its file, which fails if it is there: of two writers one wins. A record that a
    writer has not finished does not parse and is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, number: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number:09d}.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        names = (re.fullmatch(r"(\d+)\.json", n) for n in folder_names(self.spark, self.folder))
        return sorted((int(n[1]) for n in names if n), reverse=True)

    def record(self, number: int) -> dict | None:
        path, file_system = self._path(number)
        stream = file_system.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        for number in self.numbers():
            record = self.record(number)
            if record is not None:
                return number, record
        return None

    def publish(self, number: int, record: dict) -> None:
        path, file_system = self._path(number)
        if file_system.exists(path):
            raise RuntimeError(f"{path.toString()} is there already: another writer was first")
        stream = file_system.create(path, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The distinct paths that exist, in the order given."""
    return [p for p in dict.fromkeys(paths) if path_exists(spark, p)]
