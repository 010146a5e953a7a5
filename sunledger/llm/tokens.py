"""Token ids of whole texts by the word-end vocabulary of a public tokenizer.

This vocabulary drops white space and never joins letters, digits and other characters, so the ids of a
text are the ids of its words one after the other. Each worker encodes a distinct word once, with the
tokenizers library, and keeps a bounded table of them.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import texts as T


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, memory: int = T.MEMORY_WORDS):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # For parts that are normalised already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Fixed value: where this vocabulary cuts a text before its merges. Line ends stay, as marks between words.
        self.cut = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.numbers, self.ids = T.CountedWords(), T.Ragged(np.uint16)
        self.parts, self.part_ids = T.CountedWords(), T.Ragged(np.uint16)

    def _encode_parts(self, parts: list[str]) -> None:
        """Ids of parts met for the first time; the mark has none. Every part ends with an end-of-word token."""
        for start in range(0, len(parts), 4096):
            own = parts[start : start + 4096]
            here = [p for p in own if p != "\n"]
            # Spaces between them keep parts apart, and one text is encoded faster than a list of parts.
            ids = np.array(self.plain.encode_batch_fast([" ".join(here)], add_special_tokens=False)[0].ids, np.uint16)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(here):
                sizes = np.diff(np.concatenate([[-1], last]))
            else:  # a part that the tokenizer itself cuts again
                each = [e.ids for e in self.plain.encode_batch_fast(here, add_special_tokens=False)]
                ids, sizes = np.array([i for x in each for i in x], np.uint16), np.array([len(x) for x in each], np.int64)
            if len(here) < len(own):
                sizes = np.insert(sizes, own.index("\n"), 0)
            self.part_ids.extend(ids, sizes)

    def _learn(self) -> None:
        """Encode the words that were met for the first time."""
        text = b"\n".join(self.numbers.new).decode("utf-8", "replace")
        if any(s in text for s in self.special):  # such strings are ids of their own, and rare
            found = [e.ids for e in self.tokenizer.encode_batch_fast(text.split("\n"), add_special_tokens=False)]
            self.ids.extend(np.array([i for x in found for i in x], np.uint16), np.array([len(x) for x in found], np.int64))
        else:
            if len(self.parts) > self.memory // 3:
                self.part_ids = self.part_ids.only(self.parts.keep_frequent(self.memory // 6))
            parts = self.cut(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() + "\n")
            numbers = self.parts.number(parts)
            if self.parts.new:
                self._encode_parts(self.parts.new)
                self.parts.new.clear()
            sizes = self.part_ids.sizes(numbers)
            marks = np.flatnonzero(numbers == self.parts["\n"])
            upto = np.cumsum(sizes)[marks]
            self.ids.extend(self.part_ids.gather(numbers), np.diff(np.concatenate([[0], upto])))
        self.numbers.new.clear()

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.memory:
            self.ids = self.ids.only(self.numbers.keep_frequent(self.memory // 2))
        numbers = self.numbers.number(words)
        if self.numbers.new:
            self._learn()
        return numbers

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        words, counts = T.split_words(texts)
        return T.sums(self.ids.sizes(self._numbers(words)), counts)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's number of ids. A null text has none."""
        words, counts = T.split_words(texts)
        numbers = self._numbers(words)
        return self.ids.gather(numbers), T.sums(self.ids.sizes(numbers), counts)


def encoder(path: str, memory: int | None = None) -> Encoder:
    """The worker's encoder, kept from task to task. It remembers about ``memory`` distinct words."""
    memory = memory or T.MEMORY_WORDS
    return T.worker_table(("tokens", path, memory), lambda: Encoder(path, memory))


def with_token_ids(df: DataFrame, column: str, name: str, path: str, end: int | None = None, memory: int | None = None) -> DataFrame:
    """``df`` with struct ``name``: ``ids`` (binary, little-endian unsigned 32-bit) and ``n`` (long).

    ``end`` is an id put after each text's own ones. A null text counts as empty.
    ``memory`` is the number of distinct words that a worker remembers.
    """
    fields = StructType([StructField("ids", BinaryType()), StructField("n", LongType())])

    def factory():
        own = encoder(path, memory)

        def measure(texts):
            ids, counts = own.encode(texts)
            ids = ids.astype("<u4")
            if end is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
            data = pa.py_buffer(ids)
            return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), data]), counts

        return measure

    return T.append(df, column, name, fields, factory)


def with_token_count(df: DataFrame, column: str, name: str, path: str) -> DataFrame:
    """``df`` with struct ``name``: ``n`` (long), each text's number of ids; 0 for a null text."""
    fields = StructType([StructField("n", LongType())])

    def factory():
        own = encoder(path)
        return lambda texts: [own.lengths(texts)]

    return T.append(df, column, name, fields, factory)
