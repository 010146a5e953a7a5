"""Scans of site reading files."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunledger import schema as S
from sunledger.functions import readings as R
from sunledger.session import ship_package
from sunledger.storage import existing_paths, materialize

KNOWN_HEADERS = [*S.DATE_HEADERS, S.SITE_HEADER, *S.HEADER_TO_COLUMN]
_TEXT = T.StringType()
#: A file's cells under the known headers, its path, and two columns that only lines of a split file have: the line
#: itself where the header is in another split, and the header for those lines.
CELLS = T.StructType([T.StructField(c, _TEXT) for c in [*KNOWN_HEADERS, "path", "line", "header"]])


def read_readings(
    spark: SparkSession, paths: str | list[str], drop_incomplete: bool = False, skip_unreadable: bool = False
) -> DataFrame:
    """Scan many site files at once, each by its own header; source and site come from the file's name.

    Columns may be missing, in any order and among any number of others. Missing files are skipped, a
    file named twice is read once. A file that breaks while it is read fails the job, unless
    ``skip_unreadable``; ``skipped_files`` lists what has no readings.
    """
    typed = typed_readings(read_cells(spark, paths, skip_unreadable))
    return R.drop_incomplete(typed) if drop_incomplete else typed


def read_cells(spark: SparkSession, paths: str | list[str], skip_unreadable: bool = False) -> DataFrame:
    """The untyped cells of the files under the known headers, with the path of each row's file.

    One scan of the files' lines, however many layouts there are: the task that reads the start of a file knows
    its header. Lines of a file's later splits come out as they are and get their header by a join with the
    headers of the split files; then what was scanned is stored first, so that files are read once.
    """
    options = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": str(skip_unreadable).lower()}
    wanted = existing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if not wanted:
        return spark.createDataFrame([], CELLS).drop("line", "header")
    lines = spark.read.options(**options).text(_once(spark, wanted))
    scan = cells_by_name(lines)
    # Spark never splits a file below the cost of opening one. Sizes are in the listing: this opens larger files only.
    whole = int(re.sub(r"\D", "", spark.conf.get("spark.sql.files.openCostInBytes")))
    if lines.where(F.col("_metadata.file_size") > whole).select(F.lit(1)).isEmpty():
        return scan.drop("line", "header")
    scan = materialize(scan, "cells")
    # Stored by themselves, so that their size is known: a file's lines stay where they are unless the headers are too many.
    headers = materialize(scan.where(F.col("header").isNotNull()).select("path", "header"), "headers")
    rest = scan.where(F.col("line").isNotNull()).select("path", "line").join(headers, "path")
    ready = scan.where(F.col("line").isNull() & F.col("header").isNull())
    return ready.unionByName(rest.mapInArrow(_with_headers, CELLS)).drop("line", "header")


def _once(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths or globs that name every file once. Only where several of them overlap do file names pass through the driver."""
    if len(paths) < 2:
        return paths
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    twice = listed.groupBy("path").count().where("count > 1")
    if twice.isEmpty():
        return paths
    # A path as a reader takes it: without URL escapes, and with glob characters escaped.
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["path"])) for r in listed.distinct().collect()]


def cells_by_name(lines: DataFrame) -> DataFrame:
    """``CELLS`` of the lines of text files, from a batch or a stream."""
    ship_package(lines.sparkSession)
    place = F.col("_metadata")
    complete = (place["file_block_start"] == 0) & (place["file_block_length"] >= place["file_size"])
    rows = lines.select("value", place["file_path"].alias("path"), place["file_block_start"].alias("start"), complete.alias("complete"))
    return rows.mapInArrow(_by_first_line, CELLS)


def _cells(line: str) -> list[str]:
    return next(csv.reader([line]), []) if '"' in line else line.split(",")


def _header(line: str) -> list[int | None] | None:
    """Where in a header line each known header stands (the first one of that name); None for a line without any."""
    names = [c.strip() for c in _cells(line.lstrip("\ufeff"))]
    found = [names.index(n) if n in names else None for n in KNOWN_HEADERS]
    return found if any(i is not None for i in found) else None


def _named(lines: pa.Array, header: list[int | None]) -> list[pa.Array]:
    """The cells of data lines under the known headers; a line that starts with a bracket is the units row.

    Lines without quotes and of equally many cells, more than one, are cut all at once, any others one by one.
    """
    lines = lines.filter(pc.invert(pc.starts_with(lines, "[")))
    cells = pc.split_pattern(lines, ",")
    widths = np.unique(pc.list_value_length(cells).to_numpy(zero_copy_only=False))
    if len(widths) == 1 and widths[0] > 1 and not pc.any(pc.match_substring(lines, '"')).as_py():
        flat, width = cells.flatten(), int(widths[0])
        none = pa.nulls(len(lines), pa.string())
        found = [none if i is None or i >= width else flat.take(pa.array(np.arange(i, len(flat), width))) for i in header]
        return [pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c) for c in found]
    rows = [_cells(x) for x in lines.to_pylist() if x.strip()]
    return [pa.array([None if i is None or i >= len(r) else r[i] or None for r in rows], pa.string()) for i in header]


def _blocks(*columns: pa.Array) -> list[tuple[int, int]]:
    """First and end of consecutive rows that are equal in all of ``columns``."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:])) if n else []


class _CellRows:
    """Rows of ``CELLS`` in parts, joined into one batch."""

    def __init__(self):
        self.parts: list[list[pa.Array]] = [[] for _ in CELLS.names]

    def add(self, path: str, n: int, columns: list[pa.Array] | None = None, lines: pa.Array | None = None, header: str | None = None) -> None:
        none = pa.nulls(n, pa.string())
        row = [*(columns or [none] * len(KNOWN_HEADERS)), pa.repeat(pa.scalar(path, pa.string()), n)]
        row += [none if lines is None else lines, pa.repeat(pa.scalar(header, pa.string()), n)]
        for part, column in zip(self.parts, row):
            part.append(column)

    def batches(self):
        if self.parts[0]:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in self.parts], names=CELLS.names)


def _by_first_line(batches):
    """Lines of files in their order. A file's header is its first line that is not blank, wherever known words stand below."""
    headers: dict[str, list | None] = {}  # of the files that this task has read from the start
    now = None
    for batch in batches:
        values, paths, starts, complete = (batch.column(i) for i in range(4))
        values, out = values.cast(pa.string()), _CellRows()
        for at, until in _blocks(paths, starts):
            path, start = paths[at].as_py(), starts[at].as_py()
            if start == 0 and (path, start) != now:
                headers = {path: None}  # the files before are done
                now = (path, start)
                seeking = True
            if start == 0 and seeking:
                while at < until and not values[at].as_py().strip("\ufeff \t"):
                    at += 1
                if at < until:
                    headers[path], seeking = _header(values[at].as_py()), False
                    if headers[path] is not None and not complete[at].as_py():
                        out.add(path, 1, header=values[at].as_py())
                    at += 1
            lines = values.slice(at, until - at)
            if path not in headers:
                out.add(path, len(lines), lines=lines)
            elif headers[path] is not None:
                columns = _named(lines, headers[path])
                out.add(path, len(columns[0]), columns)
        yield from out.batches()


def _with_headers(batches):
    """(path, line, header) -> ``CELLS``."""
    known: dict[str, list | None] = {}
    for batch in batches:
        paths, lines, headers = (batch.column(i) for i in range(3))
        lines, out = lines.cast(pa.string()), _CellRows()
        for at, until in _blocks(paths, headers):
            header = headers[at].as_py()
            if header not in known:
                known[header] = _header(header)
            columns = _named(lines.slice(at, until - at), known[header])
            out.add(paths[at].as_py(), len(columns[0]), columns)
        yield from out.batches()


def skipped_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path): files that exist but from which no reading comes: the first line has no known header, or nothing follows it."""
    wanted = existing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if not wanted:
        return spark.createDataFrame([], "path string")
    listed = spark.read.format("binaryFile").load(wanted).select(F.col("_metadata.file_path").alias("path")).distinct()
    read = read_cells(spark, paths, skip_unreadable=True).select("path").distinct()
    return listed.join(read, "path", "left_anti")


def typed_readings(raw: DataFrame) -> DataFrame:
    """Canonical typed columns from text columns under their source headers and ``path``."""
    source = R.source_name("path")
    if S.SITE_HEADER in raw.columns:
        source = F.coalesce(F.col(S.SITE_HEADER), source)
    dates = [h for h in S.DATE_HEADERS if h in raw.columns]
    return raw.select(
        source.alias("source_id"),
        R.site_name(source).alias("site_id"),
        R.to_date(R.first_present(raw, dates)).alias("reading_date"),
        *[R.to_number(f"`{h}`").alias(c) for h, c in S.HEADER_TO_COLUMN.items() if h in raw.columns],
    )


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip the column names and give the known ones their canonical names."""
    names = [c.strip() for c in df.columns]
    return df.toDF(*[S.HEADER_TO_COLUMN.get(n, n) for n in names])
