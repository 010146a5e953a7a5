"""Quality rules from tokenizer fertility.

A public vocabulary with byte fallback is applied to every whole text. Three measures tell how well the
text fits it: characters per token, share of byte-fallback tokens, and entropy of the tokens. A text is
rejected if a measure lies outside the band of its language (of its script, where the language is not
known). Bands are robust: the median of all documents of that group and size class, plus or minus a
multiple of the median absolute deviation, never narrower than a floor, so junk may be up to half of the
documents. A class with few documents borrows its bands and never draws them from those few.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sunledger.storage import materialize

from . import texts as T

WINDOW = 8
#: Limits of the base rules: fewest words, and the largest share of words in repeated windows (per cent).
MIN_WORDS, MAX_REPEATED = 20, 30
#: Width of a band in quartile distances (twice the median absolute deviation), and the least half-width of each measure, relative to its median or absolute.
WIDTH, FLOOR_RATIO, FLOOR_SHARE, FLOOR_ENTROPY = 3.0, 0.08, 0.05, 0.12
#: Size classes of a group with fewer documents borrow the bands of its nearest one; a language without any, those of its script.
MIN_GROUP = 30
#: Quantiles that stand for a group's documents, and the size class that means all sizes.
QUANTILES, ALL_SIZES = [(k + 0.5) / 200 for k in range(200)], -1

LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
DOUBLES = ["chars_per_token", "byte_share", "token_entropy"]
FIELDS = StructType(
    [StructField(c, LongType()) for c in LONGS] + [StructField(c, DoubleType()) for c in DOUBLES] + [StructField("script", StringType())]
)

# Scripts by the first byte of a character's UTF-8 form.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "hangul", "other"]
_LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD7], "arabic": [0xD8, 0xD9, 0xDA, 0xDB], "indic": [0xE0], "cjk": [0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9],
    "hangul": [0xEA, 0xEB, 0xEC, 0xED], "other": [0xCA, 0xCB, 0xD4, 0xD5, 0xD6, 0xDC, 0xDD, 0xDE, 0xDF, 0xE1, 0xEF, 0xF0],
}
SCRIPT_OF = np.zeros(256, np.uint8)
for _name, _bytes in _LEADS.items():
    SCRIPT_OF[_bytes] = SCRIPTS.index(_name)
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
IS_SPACE, IS_SYMBOL, IS_FIRST = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
IS_SPACE[list(SPACES)] = True
IS_SYMBOL[list(SYMBOLS)] = True
IS_FIRST[0x80:0xC0] = False  # bytes that begin a character


class Pieces:
    """Token ids of distinct words, encoded once per worker with a bounded table."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids = T.WordNumbers(), T.Ragged(np.uint16)

    def number(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > T.MEMORY_WORDS:
            self._forget()
        numbers = self.numbers.number(words)
        if self.numbers.new:
            ids = self.model.encode([w.decode("utf-8", "replace") for w in self.numbers.new], num_threads=1)
            self.ids.extend(np.array([i for own in ids for i in own], np.uint16), np.array([len(own) for own in ids]))
            self.numbers.new.clear()
        return numbers


def pieces(path: str) -> Pieces:
    return T.worker_table(("pieces", path), lambda: Pieces(path))


def repeated_words(numbers: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text: how many of its words lie in a window of ``window`` words that occurs twice or more in it."""
    return T.sums(in_repeated_window(numbers, counts, window).astype(np.int64), counts)


def in_repeated_window(numbers: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``window`` words that occurs twice or more in its text.

    ``numbers`` tell words apart. Windows are compared by 64-bit hashes over the whole words and the text's place.
    """
    n = len(numbers)
    if n < window:
        return np.zeros(n, bool)
    text = np.repeat(np.arange(len(counts)), counts)
    words = T.mix(numbers.astype(np.uint64) + np.uint64(1))
    hashed = T.mix(text[: n - window + 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(window):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + words[k : n - window + 1 + k]
    begins = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    values = hashed[begins]
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(begins), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins[twice], 1)
    np.add.at(edges, begins[twice] + window, -1)
    return np.cumsum(edges)[:-1] > 0


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy of each text's tokens in relation to the most that its number of tokens allows (0 for less than two)."""
    text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    found = np.sort((text << 16) | ids)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(found)]]))
    spent = np.bincount(found[first] >> 16, weights=times * np.log2(times), minlength=len(counts)) if len(found) else np.zeros(len(counts))
    n = np.maximum(counts, 2)
    return np.where(counts > 1, (np.log2(n) - spent / n) / np.log2(n), 0.0)


def measures(path: str):
    """A task's function from texts to the arrays of ``FIELDS``."""
    own = pieces(path)

    def measure(texts):
        words, n_words = T.split_words(texts)
        numbers = own.number(words)
        n_tokens = T.sums(own.ids.sizes(numbers), n_words)
        ids = own.ids.gather(numbers)
        data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        sizes = np.array([len(t or b"") for t in texts], np.int64)
        chars = T.sums((IS_FIRST[data] & ~IS_SPACE[data]).astype(np.int64), sizes)
        scripts = np.bincount(
            np.repeat(np.arange(len(texts)) * len(SCRIPTS), sizes) + SCRIPT_OF[data], minlength=len(texts) * len(SCRIPTS)
        ).reshape(len(texts), len(SCRIPTS))
        scripts[:, 0] = 0
        tokens = np.maximum(n_tokens, 1)
        return [
            n_words,
            chars,
            T.sums(IS_SYMBOL[data].astype(np.int64), sizes),
            np.array([repeated_lines(t) if t else 0 for t in texts], np.int64),
            repeated_words(numbers, n_words),
            n_tokens,
            chars / tokens,
            T.sums(own.is_byte[ids].astype(np.int64), n_tokens) / tokens,
            entropies(ids, n_tokens),
            np.array(SCRIPTS, object)[np.argmax(scripts, axis=1)],
        ]

    return measure


def with_measures(docs: DataFrame, name: str, path: str) -> DataFrame:
    """``docs`` with struct ``name`` of all measures. Null and empty texts have zeros."""
    return T.append(docs, "text", name, FIELDS, lambda: measures(path))


def base_failed(name: str) -> Column:
    words, repeated = F.col(f"`{name}`.n_words"), F.col(f"`{name}`.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)


def _group(name: str) -> Column:
    return F.coalesce(F.col("lang"), F.concat(F.lit("script:"), F.col(f"`{name}`.script")))


def _size_class(name: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(f"`{name}`.n_words"), F.lit(1)).cast("double")) / 2).cast("int")


def bands(measured: DataFrame, name: str) -> DataFrame:
    """band_group, size_class and for each measure low and high, over the documents that pass the base rules.

    A group is a language, or a script for documents without one. Percentiles merge as sketches, so a hot
    language is summed up in every task before the shuffle. Three rows per document enter the aggregate: for
    its language, its script, and its script at all sizes. A size class with less than MIN_GROUP documents has
    the bands of the group's nearest class with so many. Where there is none, a script has those of all sizes
    and a language no row.
    """
    script, size = F.concat(F.lit("script:"), F.col(f"`{name}`.script")), _size_class(name)
    groups = F.array(*(F.struct(g.alias("band_group"), c.alias("size_class")) for g, c in ((_group(name), size), (script, size), (script, F.lit(ALL_SIZES)))))
    rows = measured.where(~base_failed(name)).select(F.explode(F.array_distinct(groups)).alias("g"), *(F.col(f"`{name}`.{m}").alias(m) for m in DOUBLES))
    quantiles = [F.percentile_approx(m, [0.5, *QUANTILES], 2000).alias(m) for m in DOUBLES]
    table = rows.groupBy("g").agg(F.count("*").alias("n"), *quantiles)

    def half(m: str, floor: Column) -> Column:
        middle = F.col(m)[0]
        away = F.sort_array(F.transform(F.slice(F.col(m), 2, len(QUANTILES)), lambda q: F.abs(q - middle)))
        return F.greatest(WIDTH * 2 * away[len(QUANTILES) // 2 - 1], floor)

    halves = {
        "chars_per_token": half("chars_per_token", FLOOR_RATIO * F.col("chars_per_token")[0]),
        "byte_share": half("byte_share", F.lit(FLOOR_SHARE)),
        "token_entropy": half("token_entropy", F.lit(FLOOR_ENTROPY)),
    }
    drawn = table.select(
        "g.*", "n", *(F.struct((F.col(m)[0] - w).alias("low"), (F.col(m)[0] + w).alias("high")).alias(m) for m, w in halves.items())
    )
    return _lent(materialize(drawn, "fertility-bands-drawn"))


def _lent(drawn: DataFrame) -> DataFrame:
    """``drawn`` with the bands of thin size classes replaced by borrowed ones."""
    thin = (F.col("n") < MIN_GROUP) & (F.col("size_class") != ALL_SIZES)
    lender = F.struct("size_class", *DOUBLES).alias("lender")
    lenders = drawn.where(~thin).select("band_group", lender)
    distance = F.when(F.col("lender.size_class") == ALL_SIZES, F.lit(1 << 20)).otherwise(F.abs(F.col("lender.size_class") - F.col("size_class")))
    nearest = F.min_by("lender", F.struct(distance, F.col("lender.size_class"))).alias("lender")
    found = drawn.where(thin).join(lenders, "band_group").groupBy("band_group", "size_class", "n").agg(nearest)
    # The entropy in bits does not fall with a text's length, its share of the most does not rise.
    bits, own = 2 * F.col("lender.size_class") + 1, 2 * F.col("size_class") + 1
    near = F.col("lender.size_class") != ALL_SIZES
    entropy = F.struct(
        F.when(near & (own > bits), F.col("lender.token_entropy.low") * bits / own).otherwise(F.col("lender.token_entropy.low")).alias("low"),
        F.when(near & (own < bits), F.col("lender.token_entropy.high") * bits / own).otherwise(F.col("lender.token_entropy.high")).alias("high"),
    )
    borrowed = found.select("band_group", "size_class", "n", "lender.chars_per_token", "lender.byte_share", entropy.alias("token_entropy"))
    return drawn.where(~thin).unionByName(borrowed)


def with_verdict(measured: DataFrame, name: str, table: DataFrame, verdict: str) -> DataFrame:
    """``measured`` with boolean ``verdict``: passes the base rules and lies in all bands. ``table`` is a stored result of
    ``bands``: Spark sees its size and broadcasts it only if it is small. It has a row for the script and size class of every
    document that passes the base rules."""
    script = F.concat(F.lit("script:"), F.col(f"`{name}`.script"))
    own, other = table.alias("own"), table.alias("other")
    joined = (
        measured.alias("row")
        .join(own, (_group(name) == F.col("own.band_group")) & (_size_class(name) == F.col("own.size_class")), "left")
        .join(other, (script == F.col("other.band_group")) & (_size_class(name) == F.col("other.size_class")), "left")
    )
    inside = F.lit(True)
    for m in DOUBLES:
        band = F.coalesce(F.col(f"own.{m}"), F.col(f"other.{m}"))
        inside = inside & F.coalesce(F.col(f"`{name}`.{m}").between(band["low"], band["high"]), F.lit(False))
    return joined.select("row.*", (~base_failed(name) & inside).alias(verdict))


def judge(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, all measures, base_failed and kept for every row of ``docs`` (doc_id, text, lang). Null text has no words and
    fails the base rules; repeated rows are judged alike; an empty table gives an empty result."""
    measured = materialize(with_measures(docs.select("doc_id", "lang", "text"), "fit", path).drop("text"), "fertility")
    table = materialize(bands(measured, "fit"), "fertility-bands")
    judged = with_verdict(measured, "fit", table, "kept")
    return judged.select("doc_id", "fit.*", base_failed("fit").alias("base_failed"), "kept")


def keep_good(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    name = T.fresh(docs.columns, "measures")
    narrow = with_measures(docs.select("lang", "text"), name, path).drop("text")
    table = materialize(bands(narrow, name), "fertility-bands")
    verdict = T.fresh([*docs.columns, name], "verdict")
    return with_verdict(with_measures(docs, name, path), name, table, verdict).where(f"`{verdict}`").select(*docs.columns)
