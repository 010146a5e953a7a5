"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``HALVES`` half-keys are computed, each half-key from ``ROWS`` minhashes. A table key is
a pair, one half-key of either collection, so 2 * HALVES * ROWS minhashes serve HALVES**2 tables of
2 * ROWS minhashes each. Documents that meet in a table are candidates, and every candidate is confirmed
on the full shingle sets.

Documents with equal shingle sets collapse into one set before banding. In each table the members are
compared with one of them, the pivot, so this round never emits the pairs of its members. What it leaves
apart is then compared pair by pair: sets that share a table and are not connected meet in groups of one
half-key, split into pairs of blocks, with a bitmap of their shingles that bounds the intersection from
above. Only pairs that the bound rules out are not confirmed, so no pair that meets in a table is lost.
First each set's most promising partner is confirmed, a few times while that connects something, then all
that is still apart. Links are united as a distributed table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from sunledger.session import ship_package
from sunledger.storage import materialize

from . import texts as T
from .components import components

SIMILARITY = 80  # per cent
ROWS, HALVES = 3, 12
#: Bits of a set's bitmap, and sets in a block of those that are compared pair by pair.
BITS, BLOCK = 4096, 2048
#: Bits of the filter that keeps most texts without a candidate out of a shuffle. Its size is fixed, so it may be broadcast.
FILTER_BITS = 1 << 24
#: So many times at most the most promising partners are confirmed before all that is still apart.
ROUNDS = 4
#: Pairs whose bitmaps are compared at once.
CHUNK = 1 << 15
#: Shingles that a confirming task remembers.
HELD_SHINGLES = 2_000_000

FIELDS = StructType(
    [StructField("n_shingles", LongType()), StructField("set_id", LongType()), StructField("halves", ArrayType(LongType()))]
)
SKETCH = StructType([StructField("n_shingles", LongType()), StructField("halves", ArrayType(LongType())), StructField("bits", BinaryType())])


class WordHashes(dict):
    """64-bit hashes of words; a worker remembers a bounded number of them."""

    def __missing__(self, word):
        if len(self) > T.MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes in one array, and their numbers.

    A-Z are lower-cased. A shingle is ``width`` words; a text with fewer words is one shingle of all of
    them, and a text without words has none.
    """
    words, counts = T.split_words([t.lower() if t else t for t in texts])  # bytes.lower() changes A-Z only
    known = T.worker_table("hashes", WordHashes)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    ends = np.cumsum(counts)
    sets = []
    for start, end in zip(ends - counts, ends):
        own = hashes[start:end]
        n = max(1, len(own) - width + 1) if len(own) else 0
        span = min(width, len(own))
        value = np.full(n, span, np.uint64)
        for k in range(span):
            value = T.mix(value * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
        sets.append(np.unique(value))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def half_keys(values: np.ndarray, sizes: np.ndarray, rows: int, halves: int) -> np.ndarray:
    """For each set with members, 2 * halves keys: minima under rows * 2 * halves hash functions, ``rows`` in each key."""
    filled = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[filled]
    out = np.zeros((2 * halves, len(sizes)), np.uint64)
    seeds = T.mix(np.arange(1, 2 * halves * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in range(2 * halves):
        key = np.full(len(starts), k + 1, np.uint64)
        for r in range(rows):
            seed = seeds[k * rows + r]
            if len(starts):
                h = (values ^ seed) * (seed | np.uint64(1))
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, starts))
        out[k, filled] = key
    return out.T


def with_signature(docs: DataFrame, name: str, width: int, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """``docs`` with struct ``name``: n_shingles, set_id (64-bit hash of the whole set, null if empty), halves."""

    def factory():
        def measure(texts):
            values, sizes = shingles(texts, width)
            keys = half_keys(values, sizes, rows, halves)
            starts = np.cumsum(sizes) - sizes
            ids = [xxhash.xxh3_64_intdigest(values[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
            empty = sizes == 0
            return [sizes, pa.array(np.array(ids, np.uint64).view(np.int64), mask=empty), _lists(keys)]

        return measure

    return T.append(docs, "text", name, FIELDS, factory)


def _lists(keys: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))


def bitmaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set BITS bits as bytes; a bit is on if a shingle of the set falls on it."""
    on = np.zeros((len(sizes), BITS), bool)
    on[np.repeat(np.arange(len(sizes)), sizes), (values % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(on, axis=1)


def with_sketch(texts: DataFrame, name: str, width: int, rows: int, halves: int) -> DataFrame:
    """``texts`` with struct ``name``: n_shingles, halves, bits."""

    def factory():
        def measure(texts):
            values, sizes = shingles(texts, width)
            bits = [row.tobytes() for row in bitmaps(values, sizes)]
            return [sizes, _lists(half_keys(values, sizes, rows, halves)), pa.array(bits, pa.binary())]

        return measure

    return T.append(texts, "text", name, SKETCH, factory)


def most_shared(sizes_a: np.ndarray, bits_a: np.ndarray, sizes_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """An upper bound of the intersections: a bit that only one set has on stands for a shingle that the other lacks."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes_a - only_a, sizes_b - only_b)


def _compare(similarity: int, halves: int, every: bool):
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(table):
        ids, label, size, block = (table.column(c).to_numpy() for c in ("set_id", "label", "n_shingles", "block"))
        keys = table.column("halves").combine_chunks().flatten().to_numpy().reshape(len(ids), 2 * halves)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        half, one, two = (table.column(c)[0].as_py() for c in ("half", "one", "two"))
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        apart = label[left][:, None] != label[right]
        apart &= 100 * np.minimum(size[left][:, None], size[right]) >= similarity * np.maximum(size[left][:, None], size[right])
        for k in range(half):  # pairs that share an earlier half-key meet there
            apart &= keys[left, k][:, None] != keys[right, k]
        met = np.zeros_like(apart)
        for k in range(halves, 2 * halves):
            met |= keys[left, k][:, None] == keys[right, k]
        apart &= met
        i, j = np.nonzero(np.triu(apart, 1) if one == two else apart)
        i, j = left[i], right[j]
        both = np.zeros(len(i), np.int64)
        for at in range(0, len(i), CHUNK):
            x, y = i[at : at + CHUNK], j[at : at + CHUNK]
            both[at : at + CHUNK] = most_shared(size[x], bits[x], size[y], bits[y])
        union = size[i] + size[j] - both
        may = 100 * both >= similarity * union
        i, j, near = i[may], j[may], both[may] / union[may]
        if not every and len(i):
            order = np.argsort(-near, kind="stable")
            order = order[np.unique(np.concatenate([np.unique(side[order], return_index=True)[1] for side in (i, j)]))]
            i, j = i[order], j[order]
        return pa.table({"a": np.maximum(ids[i], ids[j]), "b": np.minimum(ids[i], ids[j])})

    return run, schema


def apart(sketches: DataFrame, labels: DataFrame, similarity: int, halves: int, every: bool) -> DataFrame:
    """Pairs (a, b) of sets that meet in a table, have different labels and may be similar: for each set and group the most
    promising one, or with ``every`` all. A pair shares a table if it shares a half-key of either collection; it is found
    under the first one of the first collection, so a set has ``halves`` rows and not one for each table."""
    found = labels.select(F.col("node").alias("set_id"), F.col("label").alias("found"))
    named = sketches.join(found, "set_id", "left").withColumn("label", F.coalesce("found", "set_id")).drop("found")
    named = materialize(named, "apart")
    narrow = named.select("label", F.posexplode(F.slice("halves", 1, halves)).alias("half", "key"))
    sizes = narrow.groupBy("half", "key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    sizes = materialize(sizes.where("least <> most").select("half", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "apart-sizes")
    spread = named.select("*", F.posexplode(F.slice("halves", 1, halves)).alias("half", "key")).join(sizes, ["half", "key"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("set_id", "key"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("one", F.least("block", "partner")).withColumn("two", F.greatest("block", "partner"))
    run, schema = _compare(similarity, halves, every)
    return spread.groupBy("half", "key", "one", "two").applyInArrow(run, schema)


def table_keys(halves_column: str, halves: int) -> Column:
    """The HALVES**2 table keys: every half-key of the first collection with every one of the second."""
    column = F.col(halves_column)
    first, second = F.slice(column, 1, halves), F.slice(column, halves + 1, halves)
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Those ``pairs`` (a, b; set ids) whose full sets have 100 * intersection >= similarity * union.

    ``texts`` has one text for each set id; those of other sets are left where they are if the pairs are few, and
    otherwise dealt by set id once for both joins of a side. A task remembers a bounded number of sets.
    """
    ship_package(pairs.sparkSession)

    def side(end: str) -> DataFrame:
        own = texts.join(pairs.select(F.col(end).alias("set_id")).distinct(), "set_id", "left_semi")
        return own.select(F.col("set_id").alias(end), F.col("text").alias(f"text_{end}"))

    wide = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "text_a", "text_b")
    )
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("linked", BooleanType())])

    def check(batches):
        held: dict[int, np.ndarray] = {}
        room = HELD_SHINGLES

        def members(number: int, text) -> np.ndarray:
            nonlocal room
            if number not in held:
                own = shingles([text.as_py().encode()], width)[0]
                if room < len(own):
                    held.clear()
                    room = HELD_SHINGLES
                held[number], room = own, room - len(own)
            return held[number]

        for batch in batches:
            a, b, text_a, text_b = (batch.column(i) for i in range(4))
            linked = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                one, two = members(x, text_a[i]), members(y, text_b[i])
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= similarity * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return wide.mapInArrow(check, schema)


def filtered(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose set_id is not in ``wanted``; none that is in it is lost.

    A bit for each remainder of a set id, 64 in a row: at most FILTER_BITS / 64 rows, however many ids are wanted. With many
    more ids than bits it lets every row pass, and a join must settle the rest at any size.
    """
    slot = F.pmod("set_id", F.lit(FILTER_BITS))
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = materialize(bits, "filter")
    return rows.join(F.broadcast(bits), word == bits["word"]).where(bits["bits"].bitwiseAND(bit) != 0).drop(bits["word"], bits["bits"])


def near_duplicates(docs: DataFrame, width: int, similarity: int = SIMILARITY, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """``docs`` with struct ``group_column(docs)``: n_shingles, set_id, label; documents of one group share a label.

    Rows without words have null set_id and label and are linked with nothing. Rows with equal sets, repeated
    rows among them, are in one group. Only ``text`` counts. An empty table gives an empty result.
    """
    name = group_column(docs)
    signed = materialize(with_signature(docs, name, width, rows, halves), "signatures")
    filled = signed.select("text", f"`{name}`.*").where(F.col("set_id").isNotNull())
    one = filled.groupBy("set_id").agg(F.first("halves").alias("halves"))  # combined in every task before the shuffle
    keys = one.select("set_id", F.explode(table_keys("halves", halves)).alias("key"))
    # Each member of a table meets the one with the smallest id, the pivot. A running window, so no table is held in
    # memory, and a row each, so a large table gives no more than its members.
    pivot = F.first("set_id").over(Window.partitionBy("key").orderBy("set_id"))
    pairs = keys.select(F.col("set_id").alias("a"), pivot.alias("b")).where("a <> b").distinct()
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "candidates")
    # An inner join with distinct ids: Spark would move a semi-join below the filter, to all texts.
    texts = filtered(filled.select("set_id", "text"), wanted).join(wanted, "set_id").groupBy("set_id").agg(F.first("text").alias("text"))
    texts = materialize(texts, "candidate-texts")
    labels = _united(None, confirm(pairs, texts, width, similarity))[0]
    # Members of a table that are apart: one of them at least is apart from the pivot, and the pivot has met them both.
    one_label = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    other_label = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    open_pair = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    pivots = pairs.join(one_label, "a", "left").join(other_label, "b", "left").groupBy("b").agg(F.count("*").alias("n"), F.max(open_pair).alias("open"))
    pivots = materialize(pivots.where("open AND n > 1").select("b"), "open-pivots")
    rest = materialize(pairs.join(pivots, "b", "left_semi").select(F.col("a").alias("set_id")).distinct(), "open-sets")
    sketches = with_sketch(texts.join(rest, "set_id", "left_semi"), "sketch", width, rows, halves).select("set_id", "sketch.*")
    sketches = materialize(sketches, "sketches")
    for turn in range(ROUNDS):
        best = materialize(apart(sketches, labels, similarity, halves, False), "best")
        if not best.limit(1).count():
            break
        labels, linked = _united(labels, confirm(best, texts, width, similarity))
        if not linked or turn == ROUNDS - 1:
            every = materialize(apart(sketches, labels, similarity, halves, True), "every")
            labels = _united(labels, confirm(every, texts, width, similarity))[0]
            break
    set_id = F.col(f"`{name}`.set_id")
    found = T.fresh([*docs.columns, name], "found")
    named = signed.join(labels.select(F.struct("node", "label").alias(found)), set_id == F.col(f"`{found}`.node"), "left")
    label = F.coalesce(F.col(f"`{found}`.label"), set_id)
    group = F.struct(F.col(f"`{name}`.n_shingles").alias("n_shingles"), set_id.alias("set_id"), label.alias("label"))
    return named.select(*docs.columns, group.alias(name))


def _united(labels: DataFrame | None, confirmed: DataFrame) -> tuple[DataFrame, bool]:
    """``labels`` with the links of ``confirmed``, and whether there are any. The stars of ``labels`` stand for its links."""
    links = materialize(confirmed, "confirmed").where("linked").select("a", "b")
    linked = links.limit(1).count() > 0
    if labels is not None:
        if not linked:
            return labels, False
        links = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)
    return materialize(components(links), "labels"), linked


def group_column(docs: DataFrame) -> str:
    return T.fresh(docs.columns, "near_copies")


def classify(docs: DataFrame, width: int, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (doc_id = component_id) for every row.

    Null doc_ids are never a component_id unless the group has no other; then it is null and the row is kept.
    """
    labelled = near_duplicates(docs.select("doc_id", "text"), width, **options).select("doc_id", "near_copies.*")
    smallest = materialize(labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("smallest")), "smallest")
    named = labelled.join(smallest, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int, **options) -> DataFrame:
    """One row of each group of near copies, with the same columns: the smallest doc_id (null last; of repeated rows any one).

    Rows without words stay. Each task first reduces its rows to one for each group.
    """
    grouped = near_duplicates(docs, width, **options)
    label, place = F.col(f"`{group_column(docs)}`.label"), T.fresh([*docs.columns, group_column(docs)], "place")
    order = Window.partitionBy(label).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    first = grouped.where(label.isNotNull()).withColumn(place, F.row_number().over(order)).where(f"`{place}` = 1")
    return first.select(*docs.columns).union(grouped.where(label.isNull()).select(*docs.columns))
