"""Hostile small tables and plain restatements of the contracts."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack.\n"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, Size string, label string, mix string"


def hostile_rows() -> list[tuple]:
    """Nulls in any column, empty, blank, one-word, very long and repeated texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
    texts = [
        (1, GOOD * 3, "en", "a"), (2, GOOD * 3, "en", "a"), (3, GOOD * 3 + "again", "en", "b"), (None, GOOD * 3, None, None),
        (4, None, "en", "a"), (5, "", None, "b"), (6, " \t\n", "de", None), (7, "one", "de", "b"), (8, "ONE", "de", "b"),
        (9, long_text, "en", "a"), (9, long_text, "en", "a"), (10, "Ünïcödé naïve façade 漢字 кириллица \x1c é   x", "fr", "c"),
        (11, "#### $$$ |||\n#### $$$ |||\n" * 40, "en", "c"), (12, "12 34 56", None, "c"), (None, None, None, None), (13, "<|endoftext|> don't DON'T", "en", "c"),
    ]
    return [(*row, None if row[1] is None else len(row[1]), "x", "y", "z", "w", "v") for row in texts]


def hostile(spark):
    return spark.createDataFrame(hostile_rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    own = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words(text)]
    if not own:
        return set()
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def groups(links: dict, nodes) -> dict:
    """Smallest node reachable of each node, by plain search."""
    out = {}
    for node in sorted(nodes):
        if node in out:
            continue
        stack = [node]
        while stack:
            at = stack.pop()
            if at not in out:
                out[at] = node
                stack += links.get(at, ())
    return out
