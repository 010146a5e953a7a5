"""Token ids, best-fit packing, the length histogram, fertility rules and cross-entropy difference."""

import math
import random
import zlib
from collections import Counter

import llm_cases
import numpy as np
import pyarrow as pa
import pytest

from sunledger.llm import fertility, length_histogram, lm_scoring, packing, tokens

PATH = tokens.default_path()
PIECES = tokens.default_path("piece_bpe_32k.model")


def ids_of(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = [r[1] for r in llm_cases.hostile_rows()] + ["ΣΑΣ İx ²³ 12a_b", "'s'S we're", "a b　c\x85d", "e ́x", "﻿\x00\x1f"]
    ids, counts = tokens.Encoder(PATH).encode([None if t is None else t.encode() for t in texts])
    want = ids_of(texts)
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_encoder_with_a_full_table_starts_again(monkeypatch):
    monkeypatch.setattr(tokens.T, "MEMORY_WORDS", 30)
    own, texts = tokens.Encoder(PATH), [f"alpha{i} beta gamma{i % 7}!" for i in range(200)]
    got = [own.encode([t.encode()])[0].tolist() for t in texts]
    assert got == ids_of(texts)


def test_a_batch_is_handed_on_in_runs_of_bounded_size():
    texts = [None, "", *(f"{i} " * 100_000 for i in range(40)), None]
    fields = tokens.StructType([tokens.StructField("n", tokens.LongType())])
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    own = tokens.Encoder(PATH)
    out = list(tokens.T.by_runs([whole, whole.slice(0, 0)], 1, ["k", "text"], "token", fields, lambda x: [own.lengths(x)]))
    longest = max(len(t or "") for t in texts)
    assert max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in out) <= tokens.T.RUN_BYTES + longest
    assert sum((b.column(0).to_pylist() for b in out), []) == list(range(len(texts)))
    assert [n["n"] for b in out for n in b.column(2).to_pylist()] == [len(x) for x in ids_of(texts)]


def test_a_worker_remembers_few_words():
    own = fertility.Pieces(PIECES)
    held = 0
    for part in range(8):
        own.number([b"w%d" % i for i in range(part * 100_000, (part + 1) * 100_000)])
        held = max(held, len(own.numbers))
    assert held <= 400_000


def best_fit_decreasing(lengths, size):
    """One piece at a time into the tightest open bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 16, 50, 64])
    lengths = [rng.choice([1, 2, size, rng.randint(1, size)]) for _ in range(rng.randint(1, 300))]
    used = Counter()
    for length, low, high, first, each, offset in packing.plan(dict(Counter(lengths)), size):
        for r in range(low, high):
            used[first + (r - low) // each] += length
    assert sorted(size - n for n in used.values()) == best_fit_decreasing(lengths, size)


def test_packing_is_gapless_and_round_trips(spark):
    docs = llm_cases.hostile(spark)
    packed = packing.pack_documents(docs, PATH, size=256)
    rows = packed.collect()
    want = Counter()
    for row, ids in zip(llm_cases.hostile_rows(), ids_of([r[1] for r in llm_cases.hostile_rows()])):
        ids = np.array([*ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want[(row[0], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256 and len(ends) == len(best_fit_decreasing([r.length for r in rows], 256))
    held = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert all(held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)
    assert packing.pack_documents(llm_cases.empty(spark), PATH).count() == 0


def test_lengths_outside_a_sequence_are_refused(spark):
    with pytest.raises(ValueError):
        packing.best_fit(spark.createDataFrame([(1, 9)], "id long, length long"), ["id"], size=8)


def test_histogram_sums(spark):
    lengths = [len(x) for x in ids_of([r[1] for r in llm_cases.hostile_rows()])]
    table = length_histogram.histogram(llm_cases.hostile(spark), PATH).cache()
    summed = length_histogram.with_suffix_sums(table)
    counts = Counter(lengths)
    for r in summed.collect():
        own = [n for n in lengths if n >= r.length]
        assert (r.n_docs, r.n_tokens) == (counts.pop(r.length), r.length * lengths.count(r.length))
        assert (r.docs_at_least, r.tokens_at_least) == (len(own), sum(own))
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert math.isclose(r.share_at_most, sum(n <= r.length for n in lengths) / len(lengths))
    assert not counts
    for r in length_histogram.at_limits(table, [1, 8, 100_000_000]).collect():
        assert (r.n_cut, r.total) == (sum(n > r.context_limit for n in lengths), sum(lengths))
        assert r.truncated_total == sum(min(n, r.context_limit) for n in lengths) == r.total - r.tokens_lost
    for r in length_histogram.quantiles(summed, [0.25, 0.5, 1.0]).collect():
        assert r.length == sorted(lengths)[math.ceil(r.share * len(lengths)) - 1]
    assert length_histogram.with_suffix_sums(length_histogram.histogram(llm_cases.empty(spark), PATH)).count() == 0


def plain_measures(text, model):
    words = llm_cases.words(text)
    lines = [line for line in (text or "").split("\n") if llm_cases.words(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    ids = [i for w in words for i in model.encode(w)]
    n = max(len(ids), 1)
    spread = sum(-c / n * math.log2(c / n) for c in Counter(ids).values()) / math.log2(n) if len(ids) > 1 else 0.0
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_tokens": len(ids),
        "chars_per_token": sum(map(len, words)) / n, "byte_share": sum(model.is_byte(i) for i in ids) / n, "token_entropy": spread,
    }


def test_measures_equal_a_plain_count(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, r[1], r[2]) for i, r in enumerate(llm_cases.hostile_rows())]
    rng = random.Random(2)
    rows += [(100 + i, "".join(rng.choice(["ab ", "cd ", "ef\n", "\n", "gh# "]) for _ in range(rng.randint(0, 60))), "en") for i in range(60)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), PIECES).collect()}
    for i, text, _ in rows:
        want, r = plain_measures(text, model), got[i]
        for name, value in want.items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-9), (i, name)
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r.kept and r.base_failed)


def test_bands_reject_the_odd_one_and_keep_the_rest(spark):
    rng = random.Random(3)
    common = "the of and to in is was that for it with as his on be at by had not are but from or have an they which one you were".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(90)), "en", "x", 0) for i in range(300)]
    rows.append((1000, " ".join("".join(rng.choice("qxzjvkw") for _ in range(9)) for _ in range(90)), "en", "x", 0))
    rows.append((1001, " ".join("ᚠᚢᚦᚨᚱᚲ"[rng.randrange(6)] * 3 for _ in range(90)), None, "x", 0))
    rows.append((1002, rows[0][1], None, "x", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, measures int")
    kept = fertility.keep_good(docs, PIECES)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1000 not in ids and 1002 in ids and len(ids & set(range(300))) >= 299
    assert fertility.keep_good(llm_cases.empty(spark), PIECES).count() == 0
    assert fertility.judge(llm_cases.empty(spark), PIECES).count() == 0


def test_cross_entropy_difference_equals_a_plain_model(spark):
    rows = [(i, r[1]) for i, r in enumerate(llm_cases.hostile_rows())] + [(50, "good words make good text"), (50, "good words make good text"), (None, "no id")]
    target = [0, 1, 10, 50, 50, 999, None]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = lm_scoring.score_documents(docs, spark.createDataFrame([(t,) for t in target], "doc_id long"), PATH, block_tokens=500).collect()
    begin, size = -1, 49408
    pairs = [list(zip([begin, *ids[:-1]], ids)) for ids in ids_of([t for _, t in rows])]
    losses = []
    for members in ({i for i, _ in rows} | {None}, {0, 1, 10, 50}):
        counts = Counter(p for (i, _), own in zip(rows, pairs) if i in members for p in own)
        times, follows, kinds = Counter(), Counter(), Counter()
        for (a, b), n in counts.items():
            times[b] += n
            follows[a] += n
            kinds[a] += 1
        total = sum(times.values())

        def log_p(a, b, counts=counts, times=times, follows=follows, kinds=kinds, total=total):
            own = (times[b] + 1) / (total + size)
            return math.log((max(counts[a, b] - 0.75, 0) + 0.75 * kinds[a] * own) / follows[a] if follows[a] else own)

        losses.append([-sum(log_p(*p) for p in own) / len(own) if own else None for own in pairs])
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted(((i, len(own), t, b) for (i, _), own, b, t in zip(rows, pairs, *losses)), key=lambda r: key((r[0], r[1])))
    got = sorted(got, key=lambda r: key((r.doc_id, r.n_tokens)))
    assert len(got) == len(want)
    for r, (i, n, t, b) in zip(got, want):
        assert (r.doc_id, r.n_tokens) == (i, n)
        if n:
            assert math.isclose(r.target_loss, t, rel_tol=1e-8) and math.isclose(r.background_loss, b, rel_tol=1e-8) and math.isclose(r.score, t - b, abs_tol=1e-7)
        else:
            assert r.target_loss is r.background_loss is r.score is None


def test_scoring_without_documents_or_target(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.score_documents(llm_cases.empty(spark), none, PATH).count() == 0
    (row,) = lm_scoring.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none, PATH).collect()
    assert math.isclose(row.target_loss, math.log(49408))


def clean_and_junk(rng, n, junk):
    """Rows of clean English of about one length, and as many of ``junk`` texts of the same length."""
    known = "the people of this city have a long history and many of them work in small shops near the river where they sell bread fish and other food every day".split()
    clean = [(i, " ".join(rng.choice(known) for _ in range(rng.randrange(80, 120))), "en") for i in range(n)]
    odd = [(10_000 + i, " ".join("".join(rng.choice("qxzjkvwbp") for _ in range(8)) for _ in range(rng.randrange(80, 120))), "en") for i in range(junk)]
    return clean, odd


def test_junk_in_a_third_of_a_language_is_rejected(spark):
    clean, junk = clean_and_junk(random.Random(8), 200, 100)
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in fertility.judge(docs, PIECES).collect() if r.kept}
    assert not kept & {i for i, _, _ in junk} and len(kept) >= 190


@pytest.mark.parametrize("lang", ["en", None, "xx"])
def test_a_lone_very_long_junk_text_is_rejected_and_a_clean_one_stays(spark, lang):
    rng = random.Random(9)
    clean, junk = clean_and_junk(rng, 200, 200)
    long_clean = (20_000, " ".join(t for _, t, _ in clean), lang)
    odd = (20_001, " ".join(t for _, t, _ in junk), lang)
    docs = spark.createDataFrame([*clean, long_clean, odd], "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in fertility.judge(docs, PIECES).collect() if r.kept}
    assert 20_001 not in kept and 20_000 in kept


def test_a_full_encoder_keeps_frequent_words_and_all_ids():
    """Words met once make room, frequent ones are not encoded again, and every id stays that of the tokenizer."""
    from tokenizers import Tokenizer

    path = tokens.default_path()
    own, plain, learned = tokens.Encoder(path, memory=60), Tokenizer.from_file(path), []
    learn = own._learn
    own._learn = lambda: (learned.extend(own.numbers.new), learn())
    for i in range(40):
        text = "the of  and's naïve 12a-b\n" + " ".join(f"rare{chr(97 + i % 26)}{j}x{i} ñandú{j * i}ción###" for j in range(30)) + " the of"
        ids, counts = own.encode([text.encode(), None, b""])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids), 0, 0]
    assert learned.count(b"the") == 1 and learned.count("naïve".encode()) == 1
