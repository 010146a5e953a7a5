"""Cross-entropy difference of two n-gram models.

A target model is counted over documents labelled good and a background model over all documents. The two
are matched: the same public vocabulary, the same order (bigrams), the same discount and the same unigram
fallback. A document's score is the mean over its tokens of target loss minus background loss, in nats, so
lower scores are nearer to the target.

Counts of bigrams grow with the corpus, so neither model is sent to all tasks. Documents lie in blocks of
bounded size. Every block reports its distinct bigrams with their counts; Spark adds them up over all
blocks and returns to each block just the totals of its own bigrams. Only what the vocabulary bounds, sums
for each token, goes everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from sunledger.storage import materialize

from . import texts as T
from . import tokens

#: Tokens of a block (a longer document is a block of its own).
BLOCK_TOKENS = 8_000_000
DISCOUNT = 0.75
#: Tokens that a scoring task works on at a time.
RUN_TOKENS = 1 << 18
#: The number that stands before a document's first token; beyond all ids of the vocabularies used.
BEGIN = 0xFFFF

COUNTS = StructType([StructField("block", LongType()), StructField("bigram", LongType()), StructField("background", LongType()), StructField("target", LongType())])

_ARROW_COUNTS = pa.schema([(f.name, pa.int64()) for f in COUNTS.fields])


def in_blocks(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (binary, unsigned 16-bit), n, block. Null text has no tokens.

    A document counts as one token more than it has, so that a block's number of documents is bounded too.
    """
    fields = StructType([StructField("ids", BinaryType()), StructField("n", LongType()), StructField("block", LongType())])

    def factory():
        own, held, block = tokens.encoder(path), 0, TaskContext.get().partitionId() << 24

        def measure(texts):
            nonlocal held, block
            ids, counts = own.encode(texts)
            blocks = np.zeros(len(texts), np.int64)
            for i, n in enumerate(counts):
                if held and held + n + 1 > block_tokens:
                    held, block = 0, block + 1
                held += int(n) + 1
                blocks[i] = block
            offsets = np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int32)
            data = pa.py_buffer(np.ascontiguousarray(ids, "<u2"))
            return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), data]), counts, blocks

        return measure

    return T.append(docs, "text", "t", fields, factory).select("doc_id", "t.*")


def bigrams(ids: list[bytes]) -> np.ndarray:
    """Bigrams of all texts, one for each token: the token before it (or ``BEGIN``) times 65536 plus the token."""
    flat = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
    before = np.concatenate([[BEGIN], flat[:-1]]) if len(flat) else flat
    starts = np.cumsum([0] + [len(x) // 2 for x in ids[:-1]])
    before[starts[starts < len(flat)]] = BEGIN
    return (before << 16) | flat


def _add(codes: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with counts, after more codes."""
    found, n = np.unique(more, return_counts=True)
    merged, back = np.unique(np.concatenate([codes, found]), return_inverse=True)
    return merged, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(merged)).astype(np.int64)


def count_blocks(blocks: DataFrame, target_ids: DataFrame) -> DataFrame:
    """block, bigram, background, target: counts of each block's distinct bigrams.

    Texts do not move for the sake of the target: its ids meet the narrow (block, doc_id) rows, and each block gets its own.
    """
    members = materialize(blocks.select("block", "doc_id").join(target_ids, "doc_id", "left_semi"), "target-members")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        every, good, waiting, held = (empty, empty), (empty, empty), ([], []), 0
        chosen = set(right.column("doc_id").to_pylist())
        ids, names = left.column("ids").to_pylist(), left.column("doc_id").to_pylist()
        for i, (name, own) in enumerate(zip(names, ids)):
            waiting[0].append(own)
            if name in chosen:
                waiting[1].append(own)
            held += len(own) // 2
            if held >= 4 * RUN_TOKENS or i == len(ids) - 1:
                every, good = _add(*every, bigrams(waiting[0])), _add(*good, bigrams(waiting[1]))
                waiting, held = ([], []), 0
        target = np.zeros(len(every[0]), np.int64)
        target[np.searchsorted(every[0], good[0])] = good[1]
        block = (left if left.num_rows else right).column("block")[0].as_py()
        return pa.table({"block": np.full(len(every[0]), block), "bigram": every[0], "background": every[1], "target": target}, schema=_ARROW_COUNTS)

    left, right = blocks.select("block", "doc_id", "ids").groupBy("block"), members.select("block", "doc_id").groupBy("block")
    return left.cogroup(right).applyInArrow(count, COUNTS)


def totals(counts: DataFrame) -> DataFrame:
    """Each row of ``counts`` with its bigram's totals over all blocks, and ``first``: true in one of a bigram's rows."""
    same = Window.partitionBy("bigram")
    return counts.select(
        "block", "bigram", F.sum("background").over(same).alias("background"), F.sum("target").over(same).alias("target"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"),
    )


class Sums:
    """What a model needs beside its bigram counts: for each token, how often it stands, how often something follows it,
    and how many different tokens do. Arrays over all possible ids, so their size is bounded by the vocabulary."""

    def __init__(self, rows, vocabulary: int):
        self.follows, self.kinds, times = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
        for token, n_before, kinds, n in rows:
            self.follows[token], self.kinds[token], times[token] = n_before, kinds, n
        self.unigram = (times + 1) / (times.sum() + vocabulary)

    def log_p(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log-probability of each token after the one before it: absolute discounting over add-one unigrams."""
        before, own = code >> 16, self.unigram[code & 0xFFFF]
        follows = self.follows[before]
        p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * self.kinds[before] * own) / np.maximum(follows, 1)
        return np.log(np.where(follows > 0, p, own))


def sums(total: DataFrame, vocabulary: int) -> dict[str, Sums]:
    once = total.where("first").select(F.shiftright("bigram", 16).alias("before"), F.col("bigram").bitwiseAND(0xFFFF).alias("token"), "background", "target")
    models = ("background", "target")
    before = once.groupBy(F.col("before").alias("token")).agg(*(f(m) for m in models for f in (lambda m: F.sum(m).alias(m), lambda m: F.count_if(F.col(m) > 0).alias(m + "_kinds"))))
    times = once.groupBy("token").agg(*(F.sum(m).alias(m + "_times") for m in models))
    rows = before.join(times, "token", "full").na.fill(0).collect()  # one row for each token of the vocabulary at most
    return {m: Sums([(r["token"], r[m], r[m + "_kinds"], r[m + "_times"]) for r in rows], vocabulary) for m in models}


def score_documents(docs: DataFrame, target_ids: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of ``docs`` (doc_id, text).

    ``target_ids`` (doc_id) names the target documents; repeated and unknown ids change nothing. A text without tokens has null
    losses and score. Repeated rows count as often as they occur and are scored alike. Without target
    documents the target model is the uniform one.
    """
    good = target_ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    stored = materialize(in_blocks(docs.select("doc_id", "text"), path, block_tokens), "token-blocks")
    total = materialize(totals(count_blocks(stored, good)), "bigram-totals")
    from tokenizers import Tokenizer

    models = sums(total, Tokenizer.from_file(path).get_vocab_size())
    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("target_loss", DoubleType()), StructField("background_loss", DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("bigram").to_numpy()
        order = np.argsort(code)
        code = code[order]
        counts = {m: right.column(m).to_numpy()[order] for m in models}
        ids = left.column("ids").to_pylist()
        n = np.array([len(x) // 2 for x in ids], np.int64)
        losses = {m: np.zeros(len(ids)) for m in models}
        begin = 0
        while begin < len(ids):
            end, held = begin, 0
            while end < len(ids) and (end == begin or held + n[end] <= RUN_TOKENS):
                held += n[end]
                end += 1
            own = bigrams(ids[begin:end])
            at = np.searchsorted(code, own)
            for m, model in models.items():
                losses[m][begin:end] = -T.sums(model.log_p(own, counts[m][at]), n[begin:end])
            begin = end
        empty = n == 0
        mean = {m: pa.array(losses[m] / np.maximum(n, 1), mask=empty) for m in models}
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": n, "target_loss": mean["target"], "background_loss": mean["background"]})

    left, right = stored.select("block", "doc_id", "ids").groupBy("block"), total.select("block", "bigram", "background", "target").groupBy("block")
    scored = left.cogroup(right).applyInArrow(score, schema)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
