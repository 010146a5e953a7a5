"""Line dedup, lexical search and periodic runs against plain restatements of their contracts."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import compare
import llm_cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunledger.llm import lexical_search, line_dedup, periodic_runs
from sunledger.llm import texts as T
from sunledger.llm.oracles import ORACLES
from sunledger.llm.queries import QUERIES, with_planted_periods

SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# Line dedup


def plain_line_dedup(rows, least_documents=3, least_length=20):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        first = lambda found: max(found, key=lambda d: (d is not None, d or 0))
        kept = [x for x in lines if len(holders[key(x)]) < least_documents or first(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng, long_line = random.Random(4), "a line that many documents share, well over the least length"
    lines = [f"Line number {i} of a pool that documents draw from {'é' * (i % 3)}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice(lines).upper() + rng.choice(["", " \r"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(i, long_line + "\n" + f"own line of document {i} alone") for i in range(100, 400)]  # in most documents
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "short"), (504, "é" * 19), (505, "é" * 20), (506, "é" * 20), (507, " " + "é" * 20 + "\n" + "É" * 20)]
    rows += [(508, long_line), (508, long_line), (None, long_line + "\n" + lines[0]), (None, None), (509, long_line + "\n" + long_line)]
    rows += [(510, "\n".join(f"line {i % 9000} of a very long text, repeated here" for i in range(20_000)))]
    return rows


@pytest.mark.parametrize("sizes", [None, (16, 50)])
def test_line_dedup_equals_a_plain_one(spark, sizes, monkeypatch):
    if sizes:  # many shards, and hot ones in many parts
        monkeypatch.setattr(line_dedup, "SHARD", sizes[0])
        monkeypatch.setattr(line_dedup, "PART", sizes[1])
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(5)
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_line_dedup(line_rows())


def test_line_dedup_of_hostile_and_empty_tables(spark):
    docs = llm_cases.hostile(spark).withColumnRenamed("n_words", "N_Lines").withColumnRenamed("Size", "drops").withColumnRenamed("label", "owner")
    got = line_dedup.drop_repeated_lines(docs, least_documents=2, least_length=3)
    assert got.columns == [c for c in docs.columns if c != "N_Lines"] + ["n_lines", "n_dropped"]
    rows = [(r[0], r[1]) for r in llm_cases.hostile_rows()]
    want = plain_line_dedup(rows, 2, 3)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == want
    assert {(r.drops, r.owner) for r in got.collect()} == {("z", "w")} or {(r.drops, r.owner) for r in got.collect()} == {("w", "v")}
    assert line_dedup.drop_repeated_lines(llm_cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
    if n > 2:
        high[1], low[2] = high[0], low[0]  # equal in one half
    levels, bits = line_dedup.build(high, low)
    assert sorted(line_dedup.lookup(levels, bits, high, low).tolist()) == list(range(n))
    assert n == 0 or levels.sum() < 64 * 20 + 5 * n


def test_fingerprints_tell_strange_hashes():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(-(1 << 62), 1 << 62, 3000) for _ in range(2))
    table = pa.table({"shard": np.zeros(1000, np.int64), "high": high[:1000], "low": low[:1000], "n": np.full(1000, 7), "largest": pa.array([5] * 999 + [None])})
    arrays = line_dedup._build_shard(table)
    probes = pa.table({"high": high, "low": low, "doc_id": pa.array([4] * 3000)})
    got = line_dedup._probe_shard(probes, arrays)
    assert got.column("low").to_pylist() == low[:999].tolist()  # the last one's only holder has no id
    mine = line_dedup._probe_shard(pa.table({"high": high[:9], "low": low[:9], "doc_id": pa.array([5, 4, None] * 3)}), arrays)
    assert mine.column("doc_id").to_pylist() == [4, None] * 3


# Lexical search


def plain_terms(text):
    return [lower(t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(rows, items, k=20):
    docs = [(doc, Counter(plain_terms(text))) for doc, text in rows]
    docs = [(doc, c, sum(c.values())) for doc, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def search_tables(seed, n=600):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Été", "naïve", "漢字", "x1", "ABC", "Abc"]
    text = lambda most: rng.choice([" ", "\n", "--", "\x00", "~"]).join(rng.choice(pool) for _ in range(rng.randrange(1, most)))
    rows = [(i, text(60)) for i in range(n)] + [(n + i, "w1 w2 tie") for i in range(50)] + [(n + 60, None), (n + 61, ""), (n + 62, "!!"), (None, "w1 tie")]
    rows += [(5, rows[5][1])] + [(n + 70, " ".join(rng.choice(pool) for _ in range(30_000)))]
    items = [(i, text(40)) for i in range(12)] + [(20, "tie"), (21, "tie tie w1"), (22, None), (23, ""), (24, "absent words"), (None, "w3 w4"), (20, "tie"), (20, "w2")]
    return rows, items


@pytest.mark.parametrize("seed,block,asked", [(1, 1_000_000, 100_000), (2, 800, 100_000), (3, 300, 40)])
def test_search_equals_a_plain_one(spark, monkeypatch, seed, block, asked):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", asked)
    rows, items = search_tables(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(rows, items)


def test_search_of_hostile_and_empty_tables(spark):
    docs = llm_cases.hostile(spark).withColumnRenamed("label", "rank").withColumnRenamed("kept", "score")
    items = spark.createDataFrame([("a", "the QUICK naïve"), (None, "one 12"), ("b", None)], "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in lexical_search.search(docs, items).collect()), key=repr)
    assert got == plain_search([r[:2] for r in llm_cases.hostile_rows()], [("a", "the QUICK naïve"), (None, "one 12")])
    assert lexical_search.search(llm_cases.empty(spark), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def lists_of(texts, many):
    own = [np.unique(t, return_counts=True) for t in texts]
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    terms, tfs = ([x.astype(np.int32) for x in side] for side in zip(*own))
    return lexical_search.ImpactLists(np.arange(n), np.ones(n, bool), lengths, list(terms), list(tfs), many, n, int(lengths.sum()))


def test_best_positions_stop_early_and_ties_stay_whole():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, 30) for _ in range(20_000)]
    for i in range(30):  # documents that answer the query best; all have the same score
        texts[i * 600] = np.array([1, 2, 3, 4] * 7 + [49, 49])
    lists, best = lists_of(texts, 50), lexical_search.Best(20)
    met = lists.search(np.array([1, 2, 3, 4]), np.array([100, 90, 80, 70]), best)
    assert best.ids.tolist() == [i * 600 for i in range(20)] and len(set(best.scores.tolist())) == 1
    assert met < 2000  # of 20,000
    assert not lists.met.any() and (lists.column == -1).all()


# Periodic runs


def plain_runs(w, shortest=6, exponent=4):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            length = x - start + q
            if x > start and length >= max(shortest, exponent * q):
                own = w[start : start + length]
                if not any(all(own[i] == own[i + p] for i in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            x += x == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, most):
    out = []
    for _ in range(rng.randrange(0, 8)):
        root = [f"v{rng.randrange(rng.choice([2, 3, 30]))}" for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 12, 18, 19, 25]))]
        out += (root * most)[: rng.randrange(1, len(root) * most + 1)]
    return out


@pytest.mark.parametrize("shortest,exponent", [(6, 4), (3, 3), (9, 5), (1, 4)])
def test_runs_equal_plain_ones(shortest, exponent):
    rng, found = random.Random(shortest), 0
    for _ in range(150):
        texts = [periodic_words(rng, 8) for _ in range(rng.randrange(1, 6))]
        numbers = T.WordNumbers()
        flat = numbers.number([w.encode() for own in texts for w in own]).astype(np.int32)
        counts = np.array([len(t) for t in texts], np.int64)
        got, starts = periodic_runs.find(flat, counts, shortest, exponent), T.starts_of(counts)
        for i, own in enumerate(texts):
            mine = [(a - int(starts[i]), n, q) for t, a, n, q in got.tolist() if t == i]
            assert mine == plain_runs(own, shortest, exponent)
            found += len(mine)
    assert found > 100


def plain_result(text):
    w = llm_cases.words(text)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return len(w), len(runs), best, runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_texts(spark, monkeypatch):
    rng = random.Random(7)
    texts = [rng.choice([" ", "\n", " \t "]).join(periodic_words(rng, 6)) for _ in range(60)] + [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 300]
    texts += [" ".join(f"w{i % 700}" for i in range(2800)), " ".join(f"w{i % 700}" for i in range(2799)), "é É " * 9]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, runs string, Found string").repartition(3)
    for size in (1 << 20, 5):
        monkeypatch.setattr(T, "sliced_words", lambda text, size=size, f=T.sliced_words: f(text, size))
        got = periodic_runs.with_runs(docs, "r").collect()
        assert len(got) == len(texts)
        for row in got:
            r = row.r
            own = (r.n_words, r.n_runs, r.best and tuple(r.best), [tuple(x) for x in r.runs], r.collapsed)
            assert own == plain_result(texts[row.doc_id]), texts[row.doc_id]
            assert (row.runs, row.Found) == ("x", "y")


def test_runs_of_hostile_and_empty_tables(spark):
    got = sorted((tuple(r) for r in periodic_runs.with_runs(llm_cases.hostile(spark), "found").select("doc_id", "found.n_words", "found.collapsed").collect()), key=repr)
    want = []
    for row in llm_cases.hostile_rows():
        n, *_, rest = plain_result(row[1] if row[1] is None or len(row[1]) < 99_999 else None)
        want.append((row[0], n, rest) if row[1] is None or len(row[1]) < 99_999 else (row[0], 60_000, row[1]))
    long_ones = [g for g in got if g[0] == 9]
    assert len(long_ones) == 2 and {g[1] for g in long_ones} == {60_000}
    assert [g for g in got if g[0] != 9] == sorted((x for x in want if x[0] != 9), key=repr)
    assert periodic_runs.with_runs(llm_cases.empty(spark), "found").count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(llm_cases.empty(spark), "found", exponent=2)


def test_work_is_linear_in_a_text_of_one_word():
    counts = np.array([400_000], np.int64)
    assert periodic_runs.find(np.zeros(400_000, np.int32), counts).tolist() == [[0, 0, 400_000, 1]]


def test_planted_periods_follow_the_contract(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (10**12, None)]
    got = {r.doc_id: r.text for r in with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for doc, text in rows:
        w = llm_cases.words(text)
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if doc is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            text, changed = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)), changed + 1
        assert got[doc] == text
    assert changed > 20


@pytest.mark.parametrize("key", ["op11_line_dedup", "op12_lexical_search", "op13_periodic_runs"])
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_query_digests_are_of_the_results(spark, key):
    got = QUERIES[key](spark, SF_DIR).toPandas()
    assert compare.compare(got, compare.connect(SF_DIR).execute(ORACLES[key]).df()) is None
    if key == "op13_periodic_runs":
        bare = got[got.n_runs == 0]
        assert set(bare.runs_sha256) == {hashlib.sha256(b"").hexdigest()} and bare.start.isna().all()
