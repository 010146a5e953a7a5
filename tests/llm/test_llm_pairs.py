"""MinHash near-dedup, the embedding forest and connected components."""

import itertools
import os
import random
from collections import defaultdict

import compare
import llm_cases
import numpy as np
import pytest

from sunledger.llm import embedding_forest, minhash
from sunledger.llm.components import components
from sunledger.llm.oracles import ORACLES
from sunledger.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_query_equals_its_sql(spark, key):
    got, want = QUERIES[key](spark, SF_DIR).toPandas(), compare.connect(SF_DIR).execute(ORACLES[key]).df()
    assert compare.compare(got, want) is None
    # Long columns with nulls: pandas has them as doubles from Spark, as nullable integers from DuckDB.
    plain = lambda frame: {c: t.replace("Int64", "float64") for c, t in compare.types_of(frame).items()}
    assert plain(got) == plain(want)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1300)] + [(7, 8), (8, 9), (9, 7), (50, 50)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = defaultdict(list)
    for a, b in edges:
        if a != b:
            links[a].append(b)
            links[b].append(a)
    assert got == llm_cases.groups(links, links)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_force(rows, width, similarity):
    sets = {i: llm_cases.shingles(text, width) for i, text in rows}
    links = defaultdict(list)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            links[a].append(b)
            links[b].append(a)
    return sets, llm_cases.groups(links, sets)


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force_around_the_threshold(spark, width):
    rng = random.Random(width)
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for n, own in enumerate(base):  # copies that lose more and more words, so some pairs link only through others
        for k in range(8):
            changed = list(own)
            for at in rng.sample(range(120), rng.choice([0, 1, 3, 5, 7, 9, 12])):
                changed[at] = f"new{rng.randrange(10**6)}"
            rows.append((100 * n + k, " ".join(changed)))
    got = {r.doc_id: r for r in minhash.classify(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    sets, want = brute_force(rows, width, 80)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_one_common_passage_links_nothing_and_a_dense_group_is_one(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(60))) for i in range(200)]
    text = [f"d{i}" for i in range(200)]
    for i in range(200, 500):  # one word changed in each: all pairs are near copies
        own = list(text)
        own[rng.randrange(200)] = f"c{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2).collect()}
    assert got == {i: min(i, 200) for i in range(500)}


@pytest.mark.parametrize("copies", [300, 2000])
def test_copies_edited_independently_all_meet_their_original(spark, copies):
    rng = random.Random(copies)
    original = [f"o{i}" for i in range(1001)]
    rows = [(copies, " ".join(original))]
    for i in range(copies):  # about 0.85 to the original, 0.73 to each other
        own = list(original)
        for at in rng.sample(range(0, 1001, 2), 40):
            own[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    got = minhash.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2).collect()
    assert len(got) == copies + 1 and {r.component_id for r in got} == {0}


def test_the_bound_of_bitmaps_is_never_below_the_intersection():
    rng = np.random.default_rng(6)
    for size in (1, 30, 1000, 20_000):
        pool = rng.integers(0, 2**63, size * 2).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, size)) for _ in range(2))
        n = np.array([len(a), len(b)])
        bits = np.ascontiguousarray(minhash.bitmaps(np.concatenate([a, b]), n)).view(np.uint64)
        assert minhash.most_shared(n[:1], bits[:1], n[1:], bits[1:])[0] >= len(np.intersect1d(a, b))


def test_near_dedup_of_hostile_rows(spark):
    got = sorted(tuple(r) for r in minhash.classify(llm_cases.hostile(spark), 2).collect() if r.doc_id is not None)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13}
    assert [(i, c) for i, _, c, _ in got] == sorted([*want.items(), (9, 9)])
    assert all(kept == (i == c) for i, _, c, kept in got)
    assert {n for i, n, _, _ in got if i in (4, 5, 6)} == {0} and {n for i, n, _, _ in got if i in (7, 8)} == {1}
    nulls = [tuple(r) for r in minhash.classify(llm_cases.hostile(spark), 2).collect() if r.doc_id is None]
    assert sorted(nulls, key=str) == sorted([(None, 20, 1, False), (None, 0, None, True)], key=lambda r: str(r)) or {(c, k) for _, _, c, k in nulls} == {(1, False), (None, True)}


def test_one_row_of_each_group_stays_with_its_columns(spark):
    docs = llm_cases.hostile(spark)
    kept = minhash.keep_one(docs, 5)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None], key=str)
    assert minhash.keep_one(llm_cases.empty(spark), 5).count() == 0
    assert minhash.classify(llm_cases.empty(spark), 2).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, vec = [], 0
    for label in (1, 2):
        centres = rng.standard_normal((12, 16))
        for c in centres:
            for scale in rng.choice([0.0, 0.02, 0.05, 0.09, 0.12], 10):  # some pairs of a cluster link, some do not
                e = c / np.linalg.norm(c) + scale * rng.standard_normal(16)
                rows.append((vec, [float(np.float32(x)) for x in e], label))
                vec += 1
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, rows[0][1][:8]]
    for e in odd:
        rows.append((vec, e, 1))
        vec += 1
    rows += [(vec, rows[0][1], None), (vec + 1, rows[0][1], 1), (vec + 2, rows[0][1], 2), (vec + 3, rows[0][1][:8], 1), (None, rows[0][1], 1)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    got = embedding_forest.near_duplicates(table, leaf_size=24)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    result = {r.vec_id: r for r in got.collect()}

    def usable(e, label):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    units = {i: (label, np.array(e) / np.linalg.norm(e)) for i, e, label in rows if usable(e, label)}
    links = defaultdict(list)
    for a, b in itertools.permutations(units, 2):
        if units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= 0.93:
            links[a].append(b)
    big = 10**6
    known = {big if a is None else a: [big if b is None else b for b in own] for a, own in links.items()}
    want = llm_cases.groups(known, [big if i is None else i for i, _, _ in rows])
    for i, _, _ in rows:
        assert result[i].n_links == len(links[i]), i
        assert result[i].component_id == want[big if i is None else i], i
        assert result[i].kept == (i == result[i].component_id)
    assert embedding_forest.near_duplicates(table.limit(0)).count() == 0


def test_a_dense_cluster_is_compared_in_blocks(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(32)
    rows = [(i, [float(x) for x in centre / np.linalg.norm(centre) + 0.004 * rng.standard_normal(32)], 1) for i in range(300)]
    got = embedding_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf_size=40)
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(299, 0)}
