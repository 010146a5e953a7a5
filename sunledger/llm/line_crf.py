"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features describe it and its two neighbours; transitions tie
the labels of successive lines. The forward-backward marginals of all lines, weighted by their length, give
the text's share of good writing, and a logistic curve turns that into a probability.

The field is fitted on a bounded sample of labelled documents, each line with its document's label. Scoring
covers every line of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from sunledger.storage import materialize

from . import texts as T
from .fertility import IS_FIRST, IS_SPACE, IS_SYMBOL, in_repeated_window
from .language_profiles import held_out

#: Bounds of the sample that the field is fitted on: documents of each label, the lines of all of them together, and
#: the lines of one document. Documents come whole or not at all.
SAMPLE_DOCUMENTS, SAMPLE_LINES, LONGEST = 2000, 96000, 1000
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
BASE = 14
#: Own, previous and next line, whether there is a previous and a next one, and a constant.
WIDTH = 3 * BASE + 3


def _bytes(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_UPPER, _DIGIT = _bytes(range(65, 91)), _bytes(range(48, 58))
_LETTER = _bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])
_STOP = _bytes(b".,;:?")
_MARK = _bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,;:?#*$%&|<>'-"))


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features of all lines, each text's number of lines (at least 1), and each line's length in characters.

    A null text is one empty line, like an empty one.
    """
    lines, n_lines, repeated, words, n_words = [], np.zeros(len(texts), np.int64), [], [], []
    for i, text in enumerate(texts):
        own = (text or b"").split(b"\n")
        n_lines[i] = len(own)
        seen: set[bytes] = set()
        for line in own:
            parts = line.split()
            n_words.append(len(parts))
            words += parts
            repeated.append(bool(parts) and line in seen)
            seen.add(line)
        lines += own
    n_words = np.array(n_words, np.int64)
    numbers = T.WordNumbers().number(words)
    in_window = in_repeated_window(numbers, T.sums(n_words, n_lines))
    line_of = np.repeat(np.arange(len(lines)), n_words)
    again = np.zeros(len(words), np.int64)
    again[1:] = (numbers[1:] == numbers[:-1]) & (line_of[1:] == line_of[:-1])
    distinct = np.bincount(np.unique((line_of << 32) | numbers) >> 32, minlength=len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))

    def count(which: np.ndarray) -> np.ndarray:
        return T.sums(which[data].astype(np.int64), sizes).astype(np.float32)

    chars = count(IS_FIRST & ~IS_SPACE)
    full, letters, w = np.maximum(chars, 1), np.maximum(count(_LETTER), 1), np.maximum(n_words, 1).astype(np.float32)
    symbols, upper = count(IS_SYMBOL), count(_UPPER)
    x = np.stack(
        [
            symbols / full,
            upper / letters,
            count(_DIGIT) / full,
            count(_MARK) / full,
            count(_STOP) / full,
            np.minimum(chars / w / 10, 2),
            np.log1p(n_words).astype(np.float32) / 5,
            np.array(repeated, np.float32),
            (n_words == 0).astype(np.float32),
            T.sums(in_window.astype(np.int64), n_words) / w,
            (symbols > 0.3 * w).astype(np.float32),
            ((upper > 0.5 * letters) & (letters > 3)).astype(np.float32),
            T.sums(again, n_words) / w,
            np.where(n_words > 3, 1 - distinct / w, 0),
        ],
        axis=1,
    ).astype(np.float32)
    return x, n_lines, chars


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Each line's features, its neighbours' (zeros beyond the text's ends) and the constants."""
    first = np.zeros(len(x), bool)
    starts = T.starts_of(n_lines)
    first[starts[:-1]] = True
    last = np.zeros(len(x), bool)
    last[starts[1:] - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[last] = 0
    ends = np.stack([~first, ~last, np.ones(len(x), bool)], axis=1).astype(np.float32)
    return np.concatenate([x, before, after, ends], axis=1)


def marginals(e: np.ndarray, n_lines: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(good) of every line. ``e``: log-odds of good from the features; ``t[a, b]``: score of label b after a.

    Forward and backward messages are log-ratios of the two labels. Texts advance together, longest first.
    """
    order = np.argsort(-n_lines, kind="stable")
    sizes, starts = n_lines[order], T.starts_of(n_lines)[:-1][order]
    forward, backward = np.zeros(len(e)), np.zeros(len(e))
    forward[starts] = e[starts]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=1)) + 1), side="right")  # texts of at least so many lines
    for step in range(1, int(sizes.max(initial=1))):
        k = active[step]
        at = starts[:k] + step
        a = forward[at - 1]
        forward[at] = e[at] + np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
        at = starts[:k] + sizes[:k] - 1 - step
        b = e[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(b + t[1, 1], t[1, 0]) - np.logaddexp(b + t[0, 1], t[0, 0])
    return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))


def document_share(p: np.ndarray, chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Mean of the lines' P(good), weighted by their length (plus one, so that empty texts have a value)."""
    weight = chars.astype(np.float64) + 1
    return T.sums(p * weight, n_lines) / T.sums(weight, n_lines)


def fit_field(x: np.ndarray, n_lines: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the likelihood of ``y`` (0/1 of every line), by Adam."""
    d, steps = len(n_lines), int(n_lines.max())
    starts = T.starts_of(n_lines)[:-1]
    there = np.arange(steps)[None, :] < n_lines[:, None]
    at = np.where(there, starts[:, None] + np.arange(steps)[None, :], 0)
    labels = y[at]
    pairs = there[:, 1:]
    seen = np.array([[((labels[:, :-1] == a) & (labels[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], np.float64)
    theta = np.zeros(x.shape[1] + 4)
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), float(there.sum())
    for round_ in range(1, ROUNDS + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        e = (x @ w.astype(np.float32)).astype(np.float64)[at]
        alpha, beta = np.zeros((d, steps, 2)), np.zeros((d, steps, 2))
        alpha[:, 0, 1] = e[:, 0]
        for s in range(1, steps):
            step = np.logaddexp(alpha[:, s - 1, 0, None] + t[0], alpha[:, s - 1, 1, None] + t[1])
            step[:, 1] += e[:, s]
            alpha[:, s] = np.where(there[:, s, None], step, alpha[:, s - 1])
        for s in range(steps - 2, -1, -1):
            after = beta[:, s + 1] + np.stack([np.zeros(d), e[:, s + 1]], axis=1)
            step = np.logaddexp(after[:, 0, None] + t[:, 0], after[:, 1, None] + t[:, 1])
            beta[:, s] = np.where(there[:, s + 1, None], step, beta[:, s])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
        good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z)
        residual = np.zeros(len(x))
        residual[at[there]] = (labels - good)[there]
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + t[a, b] + b * e[:, 1:] + beta[:, 1:, b] - z
                expected[a, b] = np.exp(joint)[pairs].sum()
        gradient = np.concatenate([x.T @ residual.astype(np.float32), (seen - expected).reshape(-1)]) / total - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.999**round_)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_curve(share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a document's log-odds share to its label (Newton's method with a small ridge)."""
    x = np.stack([_logit(share), np.ones(len(share))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -2, 2)
    return max(float(theta[0]), 1e-3), float(theta[1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Model:
    weights: np.ndarray | None  # None: nothing but ``prior`` was learned
    transitions: np.ndarray | None
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def shares(self, texts: list[bytes | None]) -> np.ndarray:
        x, n_lines, chars = line_features(texts)
        e = (with_neighbours(x, n_lines) @ self.weights.astype(np.float32)).astype(np.float64)
        return document_share(marginals(e, n_lines, self.transitions), chars, n_lines)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.shares(texts)) + self.offset, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y, doc_id) of at most ``size`` documents of each label, and how many documents have each label.

    Documents with contradictory labels, held-out ones and null ids are left out. The choice is the order of a hash of the id.
    """
    clean = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    clean = clean.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", "y")
    clean = materialize(clean, "labels")
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    picks = [clean.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    chosen = materialize(picks[0].union(picks[1]), "label-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * size rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), counts  # one text of a repeated id


def within(sample: DataFrame, lines: int, longest: int) -> DataFrame:
    """The documents of each label with at most ``longest`` lines, in the order of their hashes, as long as their lines
    together are at most ``lines``."""
    # One narrow row for each document of the bounded sample.
    n = F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.length(F.regexp_replace("text", r"[^\n]", "")) + 1)
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sample.select("doc_id", "y", n.cast("long").alias("n")).where(F.col("n") <= longest)
    return sample.join(F.broadcast(sizes.withColumn("upto", upto).where(F.col("upto") <= lines).select("doc_id")), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES, longest: int = LONGEST) -> Model:
    """Fit on the bounded sample of whole documents. Without documents of both labels only their share is learned."""
    sample, counts = labelled_sample(docs, labels, size)
    sample = materialize(within(sample, lines, longest), "sample")
    fields = StructType([StructField("x", ArrayType(FloatType())), StructField("n", IntegerType())])

    def factory():
        def measure(texts):
            x, n_lines, _ = line_features(texts)
            offsets = np.concatenate([[0], np.cumsum(n_lines) * BASE]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1))), n_lines.astype(np.int32)]

        return measure

    rows = T.append(sample, "text", "f", fields, factory).select("doc_id", "y", "f.*").orderBy("doc_id").collect()
    ys = np.array([r["y"] for r in rows])
    if len(set(ys.tolist())) < 2:
        return Model(None, None, prior=float(ys[0]) if len(ys) else 0.5)
    n_lines = np.array([r["n"] for r in rows], np.int64)
    x = np.concatenate([np.array(r["x"], np.float32).reshape(-1, BASE) for r in rows])
    del rows
    weights, transitions = fit_field(with_neighbours(x, n_lines), n_lines, np.repeat(ys, n_lines))
    model = Model(weights, transitions)
    shares = T.append(sample, "text", "f", StructType([StructField("share", DoubleType())]), lambda: lambda texts: [model.shares(texts)])
    found = np.array([(r["share"], r["y"]) for r in shares.select("y", "f.share").collect()])
    # The sample is balanced; the curve is fitted to the labels' real shares.
    weight = np.where(found[:, 1] == 1, counts[1] / (found[:, 1] == 1).sum(), counts[0] / (found[:, 1] == 0).sum())
    model.slope, model.offset = fit_curve(found[:, 0], found[:, 1], weight / weight.mean())
    return model


def with_score(docs: DataFrame, name: str, model: Model) -> DataFrame:
    """``docs`` with struct ``name``: score, the probability of label 1 for every whole text (null and empty ones too)."""
    return T.append(docs, "text", name, StructType([StructField("score", DoubleType())]), lambda: lambda texts: [model.scores(texts)])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; repeated rows are scored alike."""
    scored = with_score(docs.select("doc_id", "text"), "s", fit(docs, labels))
    out = held_out(F.col("doc_id"), 3, 1)
    return scored.select("doc_id", out.alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with the same columns."""
    name = T.fresh(docs.columns, "quality")
    return with_score(docs, name, fit(docs, labels)).where(F.col(f"`{name}`.score") >= 0.5).select(*docs.columns)
