"""Columns computed from whole texts, one Arrow batch at a time.

``append`` adds one struct column to a table with a function over lists of UTF-8 texts. It sees a batch
in runs of a few megabytes, each handed on by itself, so the working memory of a task is bounded by the
longest single text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sunledger.session import ship_package

RUN_BYTES = 2 << 20
#: Distinct words that a worker remembers; beyond that it keeps those it met most often.
MEMORY_WORDS = 300_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def run_bounds(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """First and end of consecutive texts of about ``RUN_BYTES`` together; ``sizes`` are theirs."""
    start = end = held = 0
    for end, size in enumerate(sizes, 1):
        held += size + 16
        if held >= RUN_BYTES:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def runs(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    for start, end in run_bounds(len(t or b"") for t in texts):
        yield texts[start:end]


def by_runs(batches: Iterable[pa.RecordBatch], position: int, names: list[str], name: str, fields: StructType, measure: Callable) -> Iterator[pa.RecordBatch]:
    """``batches`` with struct ``name`` of the texts in column ``position``, one batch for each run of texts."""
    for batch in batches:
        texts = batch.column(position).cast(pa.binary())
        for start, end in run_bounds(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            arrays = [pa.array(x) if isinstance(x, np.ndarray) else x for x in measure(texts[start:end].to_pylist())]
            struct = pa.StructArray.from_arrays(arrays, fields.names)
            yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, struct], names=[*names, name])


def append(df: DataFrame, column: str, name: str, fields: StructType, factory: Callable) -> DataFrame:
    """``df`` with a struct column ``name``; ``factory()`` makes a task's function from a list of texts to
    one Arrow array (or numpy array) for each field, in the order of ``fields``."""
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(name, fields, True)])
    names, position = df.columns, df.columns.index(column)

    def compute(batches):
        yield from by_runs(batches, position, names, name, fields, factory())
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(compute, schema)


def spread(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """The fields of struct ``name`` as columns in its place; columns of the same names give way."""
    lower = {f.lower() for f in fields}
    rest = [c for c in df.columns if c != name and c.lower() not in lower]
    return df.select(*(F.col(f"`{c}`") for c in rest), *(F.col(f"`{name}`.{f}").alias(f) for f in fields))


_TABLES: dict = {}


def worker_table(key, make: Callable):
    """The table of words that this worker keeps from task to task, made by ``make`` where it is not there.

    A worker keeps one at a time: one of another kind, from an earlier stage, is dropped first. So what a worker holds
    does not rise from stage to stage.
    """
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


class WordNumbers(dict):
    """Numbers distinct words in the order of arrival; ``new`` holds those not yet described."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class CountedWords(WordNumbers):
    """Numbers of words and how often each was met, so that a full table can keep the frequent ones."""

    def __init__(self):
        super().__init__()
        self.met = np.zeros(0, np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        numbers = super().number(words)
        met = np.bincount(numbers, minlength=len(self))
        met[: len(self.met)] += self.met
        self.met = met
        return numbers

    def keep_frequent(self, most: int) -> np.ndarray:
        """Keep the words met more than once, ``most`` of them at most, under new numbers; returns their former ones in
        the new order. What was met long ago counts half each time."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(self.met[kept], len(kept) - most)[len(kept) - most :]])
        words, met = list(self), self.met[kept] // 2
        self.clear()
        self.update((words[k], i) for i, k in enumerate(kept.tolist()))
        self.met = met
        return kept


class Ragged:
    """Growing list of small integer arrays, gathered by number."""

    def __init__(self, dtype):
        self.values, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.count = np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.count + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.values[self.used : self.used + len(flat)] = flat
        self.starts[self.count + 1 : self.count + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.count += len(sizes)

    def only(self, numbers: np.ndarray) -> Ragged:
        """The arrays of ``numbers``, numbered from 0."""
        out = Ragged(self.values.dtype)
        out.extend(self.gather(numbers), self.sizes(numbers))
        return out

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The arrays of ``numbers``, one after the other."""
        sizes = self.sizes(numbers)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.values[at + np.arange(total)]


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one list, and each text's number of words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.split()  # bytes split at exactly these six characters
            counts[i] = len(own)
            words += own
    return words, counts


def sliced_words(text: bytes | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of one text as ``split_words`` gives them, in lists for about ``size`` bytes each."""
    start, end = 0, len(text or b"")
    while start < end:
        stop = _SPACE.search(text, min(start + size, end))
        stop = stop.end() if stop else end
        words = text[start:stop].split()
        if words:
            yield words
        start = stop


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` consecutive values; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
