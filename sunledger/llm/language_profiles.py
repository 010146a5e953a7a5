"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams in order. A document's own most frequent
n-grams are compared with every profile: each n-gram costs the distance between its two ranks, or the
profile's length if the profile lacks it. The language with the smallest sum wins.

N-grams are taken from lower-cased letter runs framed by a mark. Profiles are counted over all learning
documents: workers count words, turn a bounded table of distinct words into n-grams at a time, and Spark
adds up the n-grams of each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sunledger.session import ship_package
from sunledger.storage import materialize

from . import texts as T

PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
FIELDS = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
_FRAME = ord("_")


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 1..LONGEST-grams of each word's letter runs as numbers (21 bits for each character), and how many each word has."""
    framed: list[str] = []
    owners: list[int] = []
    for i, word in enumerate(words):
        text = word.decode("utf-8", "replace").lower()
        runs = [text] if text.isalpha() else "".join(c if c.isalpha() else " " for c in text).split()
        for run in runs:
            framed.append(f"_{run}_")
            owners.append(i)
    if not framed:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    run_of = np.repeat(np.arange(len(framed)), lengths)
    codes, places, value = [], [], np.zeros(len(points), np.int64)
    for n in range(1, LONGEST + 1):
        size = len(points) - n + 1
        value = (value[:size] << 21) | points[n - 1 : n - 1 + size]
        good = run_of[:size] == run_of[n - 1 : n - 1 + size]
        if n == 1:
            good &= points[:size] != _FRAME
        at = np.flatnonzero(good)
        codes.append(value[at])
        places.append(at)
    codes, places = np.concatenate(codes), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    owner = np.array(owners, np.int64)[run_of[places[order]]]
    return codes[order], np.bincount(owner, minlength=len(words))


class Grams:
    """N-grams of distinct words under small numbers, one bounded table per worker."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.grams = T.CountedWords(), T.Ragged(np.int32)
        self.places: dict[int, int] = {}
        self.codes = np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.numbers) > T.MEMORY_WORDS // 2

    def number(self, words: list[bytes]) -> np.ndarray:
        if self.full():
            if len(self.codes) > T.MEMORY_WORDS:
                self._forget()
            else:
                self.grams = self.grams.only(self.numbers.keep_frequent(T.MEMORY_WORDS // 4))
        numbers = self.numbers.number(words)
        if self.numbers.new:
            codes, sizes = grams_of(self.numbers.new)
            distinct, back = np.unique(codes, return_inverse=True)
            known = self.places
            fresh = [c for c in distinct.tolist() if c not in known]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.codes = np.concatenate([self.codes, np.array(fresh, np.int64)])
            ids = np.array([known[c] for c in distinct.tolist()], np.int32)
            self.grams.extend(ids[back] if len(back) else np.zeros(0, np.int32), sizes)
            self.numbers.new.clear()
        return numbers


def text_of(code: int) -> str:
    """The n-gram of a number."""
    points = []
    while code:
        points.append(chr(code & 0x1FFFFF))
        code >>= 21
    return "".join(reversed(points))


def profiles(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """``docs`` (lang, text) -> lang, gram, rank (0 for the most frequent), ``length`` rows a language at most.

    Rows without language or text teach nothing. N-grams of equal count are ordered by their characters.
    """
    ship_package(docs.sparkSession)
    schema = StructType([StructField("lang", StringType()), StructField("code", LongType()), StructField("n", LongType())])

    def count(batches):
        own, sums = Grams(), {}

        def emit():
            for lang, held in sums.items():
                seen = np.flatnonzero(held)
                sizes = own.grams.sizes(seen)
                n = np.bincount(own.grams.gather(seen), weights=np.repeat(held[seen], sizes), minlength=len(own.codes))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(own.codes[at]), pa.array(n[at].astype(np.int64))], names=schema.names)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            start = 0
            for run in T.runs(texts):
                words, counts = T.split_words(run)
                if own.full():  # its numbers are about to start again
                    yield from emit()
                    sums.clear()
                numbers = own.number(words)
                speakers = np.repeat(langs[start : start + len(run)], counts)
                for lang in set(langs[start : start + len(run)]):
                    found = np.bincount(numbers[speakers == lang], minlength=len(own.numbers)).astype(np.float64)
                    before = sums.get(lang)
                    if before is not None:
                        found[: len(before)] += before
                    sums[lang] = found
                start += len(run)
        yield from emit()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = rows.mapInArrow(count, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")) - 1
    return totals.withColumn("rank", rank).where(F.col("rank") < length).select("lang", F.col("code").alias("gram"), "rank")


def identify(table: list[tuple[str, int, int]], length: int = PROFILE):
    """A task's factory from texts to lang_pred and score, for the rows of ``profiles``."""
    langs = sorted({row[0] for row in table})
    places = {lang: i for i, lang in enumerate(langs)}
    by_code: dict[int, list[tuple[int, int]]] = {}
    for lang, code, rank in table:
        by_code.setdefault(code, []).append((places[lang], rank))

    def factory():
        own = Grams()
        ranks = np.zeros((len(langs), 0), np.int32)

        def extend() -> np.ndarray:
            """Ranks of all n-grams numbered so far in every profile; -1 where a profile lacks one."""
            more = np.full((len(langs), len(own.codes) - ranks.shape[1]), -1, np.int32)
            for i, code in enumerate(own.codes[ranks.shape[1] :].tolist()):
                for lang, rank in by_code.get(code, ()):
                    more[lang, i] = rank
            return np.concatenate([ranks, more], axis=1)

        def measure(texts):
            nonlocal ranks
            words, counts = T.split_words(texts)
            if own.full():
                ranks = ranks[:, :0]
            numbers = own.number(words)
            if ranks.shape[1] < len(own.codes):
                ranks = extend()
            names, scores, end = [], np.zeros(len(texts)), 0
            for i, n in enumerate(counts):
                mine, end = numbers[end : end + n], end + n
                mine, times = np.unique(mine, return_counts=True)
                ids = own.grams.gather(mine)
                if not len(ids) or not langs:
                    names.append(UNKNOWN)
                    continue
                total = np.bincount(ids, weights=np.repeat(times, own.grams.sizes(mine)))
                there = np.flatnonzero(total)
                if len(there) > length:  # all that tie with the last one stay until they are ordered
                    least = np.partition(total[there], len(there) - length)[len(there) - length]
                    there = there[total[there] >= least]
                top = there[np.lexsort((own.codes[there], -total[there]))][:length]
                found = ranks[:, top]
                cost = np.where(found < 0, length, np.abs(found - np.arange(len(top)))).sum(axis=1)
                best = int(np.argmin(cost))
                names.append(langs[best])
                scores[i] = 1 - cost[best] / (length * len(top))
            return [pa.array(names, pa.string()), np.clip(scores, 0, 1)]

        return measure

    return factory


def with_language(docs: DataFrame, name: str, table: DataFrame, length: int = PROFILE) -> DataFrame:
    """``docs`` with struct ``name``: lang_pred and score (1 minus the mean distance in relation to the largest one).

    Null texts and texts without letters are ``und`` with score 0, and so is everything if nothing was learned. Of equally near languages the
    first by name wins. ``table`` has at most ``length`` rows for each language and goes to every task.
    """
    rows = [(r["lang"], r["gram"], r["rank"]) for r in table.collect()]
    return T.append(docs, "text", name, FIELDS, identify(rows, length))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify_documents(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; learned from the rows that are not held out (nor without id)."""
    docs = docs.select("doc_id", "lang", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    table = materialize(profiles(docs.where(~out & F.col("doc_id").isNotNull()), length), "profiles")
    return with_language(docs.select("doc_id", "text"), "l", table, length).select("doc_id", out.alias("held_out"), "l.*")
