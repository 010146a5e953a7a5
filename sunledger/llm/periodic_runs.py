"""Periodic runs of words by seeds and extension along diagonals.

A run is a stretch of consecutive words with smallest period q, at least ``shortest`` words and ``exponent``
periods long, that no neighbouring word extends. Words q apart are equal in it, so it lies on the diagonal
of lag q of the text compared with itself, where it matches at least ``max(shortest - q, (exponent - 1) * q)``
words in a row: the overlap that is guaranteed.

Lags are taken in ranges ``low..k``. The words' k-grams are indexed for the least overlap k that is guaranteed
from ``low`` on, and occurrences of one k-gram in one text are paired, each with the next one only: inside a
run whose smallest period is at most k, a k-gram comes again after exactly one period and never before. So
pairs are at most as many as words, and no run is without a seed. A seed that the table of furthest covered
positions of its lag has not reached yet is extended to both sides, word by word. Ranges grow by the factor
``exponent - 1``, and only places whose shorter grams occur twice in their text go on to the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import texts as T

SHORTEST, EXPONENT = 6, 4
#: Words compared at once while a seed is extended, at first and at most.
FIRST_STEP, LAST_STEP = 64, 1 << 16
#: Words joined at once.
JOINED = 1 << 16

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
FIELDS = StructType(
    [StructField("n_words", LongType()), StructField("n_runs", LongType()), StructField("best", RUN), StructField("runs", ArrayType(RUN)),
     StructField("collapsed", StringType())]
)
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def guaranteed(lag: int, shortest: int, exponent: int) -> int:
    """Words that a run of smallest period ``lag`` matches in a row on its diagonal, at least."""
    return max(shortest - lag, (exponent - 1) * lag)


def ranges(longest: int, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(low, k): k-grams find all runs of periods low..k; up to the longest period that ``longest`` words have room for."""
    if exponent < 3:
        raise ValueError("exponent must be at least 3: ranges of lags would not grow")
    out, low = [], 1
    while max(shortest, exponent * low) <= longest:
        k = min(guaranteed(lag, shortest, exponent) for lag in range(low, max(low, shortest) + 1))
        out.append((low, k))
        low = k + 1
    return out


class Grams:
    """Equal grams of one text have equal names. Places whose gram occurs once in its text are left out."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray):
        self.n = len(numbers)
        text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        key = text * (int(numbers.max(initial=0)) + 1) + numbers
        self.names, self.places, self.size = self._named(np.arange(self.n), key), None, 1
        self.places = np.flatnonzero(self.names >= 0)

    def _named(self, places: np.ndarray, key: np.ndarray) -> np.ndarray:
        names = np.full(self.n, -1, np.int64)
        if len(places):
            order = np.argsort(key, kind="stable")
            found = key[order]
            first = np.concatenate([[True], found[1:] != found[:-1]])
            name = np.cumsum(first) - 1
            many = np.bincount(name) > 1
            names[places[order]] = np.where(many[name], name, -1)
        return names

    def _longer(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of grams of ``size`` words, at most twice the present size: two present ones that cover it."""
        step = size - self.size
        places = self.places[self.places + step < self.n]
        places = places[self.names[places + step] >= 0]
        # A repeated gram never reaches over the end of a text: names tell texts apart, and that border is there once.
        key = self.names[places] * (int(self.names.max(initial=0)) + 1) + self.names[places + step]
        names = self._named(places, key)
        return names, places[names[places] >= 0]

    def grow(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of the grams of ``size`` words, which must not decrease from call to call."""
        while 2 * self.size <= size:
            self.names, self.places = self._longer(2 * self.size)
            self.size *= 2
        return (self.names, self.places) if size == self.size else self._longer(size)


def _matches(words: np.ndarray, at: int, lag: int, most: int, step: int) -> int:
    """How many words in a row from ``at`` in direction ``step`` (1 or -1) equal the word ``lag`` later, at most ``most``."""
    done, size = 0, FIRST_STEP
    while done < most:
        size = min(size, most - done)
        low = at + done if step > 0 else at - done - size + 1
        same = words[low : low + size] == words[low + lag : low + lag + size]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + size, min(2 * size, LAST_STEP)
    return done


def find(numbers: np.ndarray, counts: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """All runs of texts given as word numbers one after the other: rows (text, start in all words, length, period),
    by text, start and period."""
    starts = T.starts_of(counts)
    found: list[tuple[int, int, int, int]] = []
    grams = Grams(numbers, counts)
    for low, k in ranges(int(counts.max(initial=0)), shortest, exponent):
        names, places = grams.grow(k)
        if not len(grams.places):
            break
        order = np.argsort(names[places], kind="stable")  # by gram, then by place
        name, place = names[places][order], places[order]
        lag = place[1:] - place[:-1]
        seed = np.flatnonzero((name[1:] == name[:-1]) & (lag >= low) & (lag <= k))
        at, lag = place[:-1][seed], lag[seed]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # The word before is a seed of the same lag too: extending that one covers this one.
        head = np.ones(len(at), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}  # for each lag the end of the matches found so far; texts follow one another
        text = np.searchsorted(starts, at[head], side="right") - 1
        for i, q, t in zip(at[head].tolist(), lag[head].tolist(), text.tolist()):
            if i < covered.get(q, 0):
                continue
            begin = i - _matches(numbers, i - 1, q, i - int(starts[t]), -1)
            end = i + k + _matches(numbers, i + k, q, int(starts[t + 1]) - q - i - k, 1)
            covered[q] = end
            length = end - begin + q
            if length >= max(shortest, exponent * q):
                found.append((t, begin, length, q))
    rows = np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64)
    return rows.reshape(-1, 4)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edges)[:-1] == 0


def strongest(runs: np.ndarray) -> int:
    """The run with the greatest exact length / period, then the first, then the shortest period. ``runs`` are in order."""
    best = 0
    for i in range(1, len(runs)):
        if int(runs[i, 2]) * int(runs[best, 3]) > int(runs[best, 2]) * int(runs[i, 3]):
            best = i
    return best


def _measure(texts: list[bytes | None], shortest: int, exponent: int) -> list:
    numbers = T.WordNumbers()
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for words in T.sliced_words(text):
            parts.append(numbers.number(words).astype(np.int32))
            counts[i] += len(words)
    flat = np.concatenate([np.zeros(0, np.int32), *parts])
    distinct, starts = numbers.new, T.starts_of(counts)
    runs = find(flat, counts, shortest, exponent)
    kept = collapsed(len(flat), runs)
    first = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    own, best, left = [], [], []
    for i in range(len(texts)):
        mine = runs[first[i] : first[i + 1]]
        shown = [{"start": s - int(starts[i]), "length": n, "period": q} for _, s, n, q in mine.tolist()]
        own.append(shown)
        best.append(shown[strongest(mine)] if shown else None)
        rest = flat[starts[i] : starts[i + 1]][kept[starts[i] : starts[i + 1]]]
        pieces = (b" ".join(map(distinct.__getitem__, rest[a : a + JOINED].tolist())) for a in range(0, len(rest), JOINED))
        left.append(b" ".join(pieces))
    runs_column = pa.array(own, pa.list_(_ARROW_RUN))
    return [counts, np.diff(first).astype(np.int64), pa.array(best, _ARROW_RUN), runs_column, pa.array(left, pa.binary()).view(pa.string())]


def with_runs(docs: DataFrame, name: str, column: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with struct ``name``: n_words, n_runs, best (the run with the greatest length / period, null without runs),
    runs (start, length, period; by start, then period) and collapsed (the words that no run contains after its first
    period, joined by one space).

    Rows are judged one by one, so repeated rows, ties and rows with nulls elsewhere keep their own results. A null or
    blank text has no words, no runs and collapses to the empty text. An empty table gives an empty result. Texts are
    taken whole; the memory of a task is a multiple of its longest one.
    """
    ranges(0, shortest, exponent)
    return T.append(docs, column, name, FIELDS, lambda: lambda texts: _measure(texts, shortest, exponent))
