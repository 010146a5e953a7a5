"""Ranked lexical search by the Best Position Algorithm.

The documents' terms that occur in some query are kept as postings, one narrow row for each document, so texts are
read once and never shuffled. Each task takes its documents in blocks of bounded size. For each term of a block
there is an impact list, its postings by falling impact. A query goes down the lists of its terms in step. A
document met for the first time is looked up in all other lists at once (direct access), which gives its whole
score and its positions in them. In each list the best position is the end of the stretch from the top whose
positions have all been seen, whether from going down or by direct access. No unseen document can score above the
sum of the impacts at the best positions, which is never more than the sum at the positions last read; the search of
a block stops when that sum is strictly below the kth score so far, over all blocks of the task, so ties are whole.

A task hands on at most k documents of a query, and the tasks' best are ranked by a window with a limit.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from sunledger.session import ship_package
from sunledger.storage import materialize

from . import texts as T

TOP = 20
#: Queries are taken in blocks with about so many terms (or one query, if it alone has more).
QUERY_TERMS = 100_000
#: Postings of a block of documents, and positions that each list goes down at first.
BLOCK, FIRST_DEPTH = 1_000_000, 16

POSTINGS = StructType([StructField("n", LongType()), StructField("terms", BinaryType()), StructField("tfs", BinaryType())])
FOUND = StructType([StructField("query", LongType()), StructField("doc_id", LongType()), StructField("score", LongType())])
_ITEM = [StructField("terms", ArrayType(BinaryType())), StructField("n", LongType())]
#: ASCII letters and digits and all bytes of other characters stay, A-Z are lower-cased, the rest separates terms.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers in ``vocabulary``, ascending) and tfs (binary, 32-bit), for
    documents with a term at all."""
    numbers = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    many = len(vocabulary)

    def factory():
        number = numbers.value.get

        def measure(texts):
            counts, out = np.zeros(len(texts), np.int64), ([], [])
            for i, text in enumerate(texts):
                own = terms(text)
                counts[i] = len(own)
                found = np.fromiter(map(number, own, itertools.repeat(many)), np.int64, len(own))
                times = np.bincount(found, minlength=many + 1)[:many] if len(found) > many else None
                which, times = (np.flatnonzero(times), times[times > 0]) if times is not None else np.unique(found[found < many], return_counts=True)
                out[0].append(which.astype(np.int32).tobytes())
                out[1].append(times.astype(np.int32).tobytes())
            return [counts, *(pa.array(x, pa.binary()) for x in out)]

        return measure

    rows = T.append(docs.select(F.col("doc_id").cast("long"), "text"), "text", "p", POSTINGS, factory)
    return rows.select("doc_id", "p.*").where("n > 0")


def document_counts(stored: DataFrame, many: int) -> dict[int, int]:
    """df of each term; at most one row for each of the ``many`` terms of the queries."""

    def count(batches):
        total = np.zeros(many, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total[np.frombuffer(held.as_buffer(), np.int32)] += 1
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total[which])], names=["term", "df"])

    parts = stored.select("terms").mapInArrow(count, "term long, df long")
    return {r.term: r.df for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class ImpactLists:
    """The impact lists of one block of documents, and the postings of each document for direct access."""

    def __init__(self, ids, named, lengths, terms, tfs, many: int, n_docs: int, n_terms: int):
        self.ids, self.named = ids, named
        sizes = np.array([len(t) for t in terms], np.int64)
        self.starts = T.starts_of(sizes)
        self.term = np.concatenate([np.zeros(0, np.int32), *terms])
        tf = np.concatenate([np.zeros(0, np.int32), *tfs]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        # 25 * n * N fits 64 bits up to n * N = 3.6e17.
        weight = 100 - 25 + (25 * lengths * n_docs) // n_terms
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * weight[self.doc])
        self.ranked = np.lexsort((self.doc, -self.impact, self.term))
        sizes = np.bincount(self.term, minlength=many)
        self.heads = T.starts_of(sizes)
        self.place = np.empty(len(self.term), np.int64)
        self.place[self.ranked] = np.arange(len(self.term)) - self.heads[self.term[self.ranked]]
        self.column = np.full(many, -1, np.int64)
        self.met = np.zeros(len(lengths), bool)

    def search(self, query: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the block's best documents for a query (distinct terms and their weights) into ``best``. Returns how
        many documents were met."""
        has = self.heads[query + 1] > self.heads[query]
        query, weights = query[has], weights[has]
        if not len(query):
            return 0
        self.column[query] = np.arange(len(query))
        heads, sizes = self.heads[query], self.heads[query + 1] - self.heads[query]
        first = T.starts_of(sizes)  # of each list in `seen`
        seen, position, met = np.zeros(first[-1] + 1, bool), np.zeros(len(query), np.int64), []
        depth, step = 0, FIRST_DEPTH
        while depth < sizes.max():
            taken = np.clip(sizes - depth, 0, step)
            offset = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken) + depth
            seen[np.repeat(first[:-1], taken) + offset] = True
            docs = self.doc[self.ranked[np.repeat(heads, taken) + offset]]
            fresh = np.unique(docs[~self.met[docs]])
            if len(fresh):
                self.met[fresh] = True
                met.append(fresh)
                # Direct access: all postings of the new documents.
                n = self.starts[fresh + 1] - self.starts[fresh]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(self.starts[fresh] - (ends - n), n)
                column = self.column[self.term[at]]
                known = column >= 0
                seen[first[column[known]] + self.place[at[known]]] = True
                scores = np.add.reduceat(np.where(known, weights[column] * self.impact[at], 0), ends - n)
                best.add(scores, self.ids[fresh], self.named[fresh])
            depth, step = depth + step, 2 * step
            bound = 0
            for i in range(len(query)):
                held = seen[first[i] + position[i] : first[i] + sizes[i]]
                gap = int(held.argmin()) if len(held) else 0
                position[i] += gap if len(held) and not held[gap] else len(held)
                if position[i] < sizes[i]:
                    bound += int(weights[i]) * int(self.impact[self.ranked[heads[i] + position[i] - 1]])
            if bound < best.least():
                break
        self.column[query] = -1
        for docs in met:
            self.met[docs] = False
        return sum(map(len, met))


class Best:
    """The k highest scores above 0; equal ones by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.named = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        good = scores >= max(self.least(), 1)
        scores, ids, named = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.named, named[good])))
        order = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]

    def least(self) -> int:
        """The kth score; 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def blocks(batches, many: int, n_docs: int, n_terms: int):
    """``ImpactLists`` of about ``BLOCK`` postings each, from batches of (doc_id, n, terms, tfs)."""
    held, size = [], 0

    def lists() -> ImpactLists:
        ids, lengths = (pa.chunked_array([b.column(i) for b in held]) for i in (0, 1))
        own = [[np.frombuffer(x.as_buffer(), np.int32) for b in held for x in b.column(i)] for i in (2, 3)]
        return ImpactLists(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), lengths.to_numpy(), *own, many, n_docs, n_terms)

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            held.append(batch.slice(start, 1000))
            size += sum(len(x.as_buffer()) // 4 for x in held[-1].column(2))
            if size >= BLOCK:
                yield lists()
                held, size = [], 0
    if held:
        yield lists()


def best_documents(stored: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], many: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of each query (distinct terms, weights)."""
    asked = stored.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best = [Best(k) for _ in asked.value]
        if not best:
            return
        for lists in blocks(batches, many, n_docs, n_terms):
            for (query, weights), found in zip(asked.value, best):
                lists.search(query, weights, found)
        query = np.repeat(np.arange(len(best)), [len(found.scores) for found in best])
        joined = [np.concatenate([getattr(found, x) for found in best]) for x in ("ids", "named", "scores")]
        ids = pa.array(joined[0], mask=~joined[1])
        yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(joined[2])], names=FOUND.names)

    return stored.select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): for each item the k documents with the highest scores above 0.

    The score is the sum over the item's terms, repeats included, of
    ``w * ((10**9 * tf) div (1000 * tf + 12 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
    ``m = 100 - 25 + (25 * n * N) div L``. Every row of ``docs`` is a document, so repeated rows have ranks of their
    own; equal scores are in the order of doc_id, null last. Rows of ``items`` that are equal in item_id and text are
    one item; rows equal in item_id alone are ranked each by itself. Null and empty texts have no terms: such documents
    count for nothing, such items have no rows. Empty tables give an empty result. Other columns are not read. Scores
    are 64-bit integers.

    ``docs`` is read once for each block of items (``QUERY_TERMS``); only the items of one block are held in the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = items.select("item_id", "text").distinct()

    def split(batches):
        for batch in batches:
            own = [terms(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            arrays = [batch.column(0), pa.array(own, pa.list_(pa.binary())), pa.array([len(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "terms", "n"])

    asked = asked.mapInArrow(split, StructType([items.schema["item_id"], *_ITEM])).where("n > 0")
    asked = materialize(asked.withColumn("dealt", F.pmod(F.xxhash64("item_id", "terms"), F.lit(1 << 20)).cast("int")), "queries")
    n_blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // QUERY_TERMS))
    parts = []
    for block in range(n_blocks):
        own = asked.where(F.col("dealt") % n_blocks == block).orderBy("item_id", "dealt").collect()  # about QUERY_TERMS terms
        vocabulary = sorted({bytes(t) for r in own for t in r.terms})
        number, many = {t: i for i, t in enumerate(vocabulary)}, len(vocabulary)
        stored = materialize(postings(docs, vocabulary), "postings")
        n_docs, n_terms = stored.agg(F.count("*"), F.sum("n")).first()
        frequency = document_counts(stored, many)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
        queries = []
        for r in own:
            times = Counter(number[bytes(t)] for t in r.terms)
            used = sorted(t for t in times if weight.get(t, 0) > 0)
            queries.append((np.array(used, np.int64), np.array([times[t] * weight[t] for t in used], np.int64)))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], StructType([StructField("query", LongType()), items.schema["item_id"]]))
        found = best_documents(stored, queries, many, n_docs or 0, n_terms or 1, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(materialize(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
