"""Line dedup by a sharded minimal perfect hash.

Lines are known by 128-bit hashes of their keys. The distinct hashes that occur in enough documents are dealt to
shards of a few thousand. For each shard a minimal perfect hash is built: bit fields, level by level, in each of
which the hashes that fall on a bit of their own are settled and the others go on. A hash's place is the number
of bits set before its own one, so the arrays it indexes have no gaps: a fingerprint of 64 bits, the number of
documents, and the largest document. The other half of the hash chooses shard and place.

Documents probe these arrays; their lines are not joined with lines. What travels to a shard are hashes with the
document's id, dealt to as many parts as the shard's rows need (a line may be in every document), each of which
gets the shard's arrays. A hash that is not in the arrays is told by its fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sunledger.session import ship_package
from sunledger.storage import materialize

from . import texts as T

#: Hashes of a shard, and probes of one part of a shard, about (both are dealt by hash).
SHARD, PART = 4096, 32_768
#: Bits of a level for each hash that is not settled yet, rounded up to whole words.
ROOM = 1.5

HASHES = StructType([StructField("high", LongType()), StructField("low", LongType()), StructField("doc_id", LongType())])
ARRAYS = StructType(
    [StructField("shard", LongType()), StructField("levels", BinaryType()), StructField("bits", BinaryType()), StructField("fingerprints", BinaryType()),
     StructField("counts", BinaryType()), StructField("largest", BinaryType()), StructField("named", BinaryType())]
)


def digests(text: bytes | None, least_length: int) -> list[bytes | None]:
    """For each line the 128-bit hash of its key, None for keys of less than ``least_length`` code points.

    A key is the line without white space at its ends and with A-Z lower-cased.
    """
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip().lower()  # of bytes: exactly the six characters, and A-Z only
        long_enough = len(key) >= least_length and (len(key) >= 4 * least_length or len(key.decode("utf-8", "replace")) >= least_length)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def line_hashes(docs: DataFrame, least_length: int) -> DataFrame:
    """(high, low, doc_id), once for each distinct key of a text."""
    ship_package(docs.sparkSession)

    def compute(batches):
        for batch in batches:
            texts, ids = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0)
            at = 0
            for run in T.runs(texts):
                own = [list({d for d in digests(text, least_length) if d}) for text in run]
                halves = np.frombuffer(b"".join(d for found in own for d in found), "<i8").reshape(-1, 2)
                rows = ids.take(pa.array(at + np.repeat(np.arange(len(run)), [len(found) for found in own])))
                at += len(run)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), rows], names=HASHES.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, HASHES)


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = T.mix(np.array([level + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (T.mix(high ^ seed) + T.mix(low * (seed | np.uint64(1)))) % np.uint64(size)


def build(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels (bits, multiples of 64), and their bits as 64-bit words. The hashes must be distinct."""
    levels, words = [], []
    while len(high):
        size = 64 * max(1, int(np.ceil(ROOM * len(high) / 64)))
        place = _places(high, low, len(levels), size).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size // 64, np.uint64)
        np.bitwise_or.at(bits, place[alone] >> 6, np.uint64(1) << (place[alone] & 63).astype(np.uint64))
        levels.append(size)
        words.append(bits)
        high, low = high[~alone], low[~alone]
    return np.array(levels, np.int64), np.concatenate([np.zeros(0, np.uint64), *words])


def lookup(levels: np.ndarray, bits: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Place of each hash, 0 to n - 1 without gaps for those built in; others get any place or -1."""
    before = np.cumsum(np.bitwise_count(bits).astype(np.int64)) - np.bitwise_count(bits)
    out = np.full(len(high), -1, np.int64)
    left, first = np.arange(len(high)), 0
    for level, size in enumerate(levels.tolist()):
        place = _places(high[left], low[left], level, size).astype(np.int64)
        word, bit = first + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
        on = (bits[word] & bit) != 0
        out[left[on]] = before[word[on]] + np.bitwise_count(bits[word[on]] & (bit[on] - np.uint64(1)))
        left, first = left[~on], first + size // 64
    return out


def _unsigned(table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().view(np.uint64)


def _build_shard(table):
    high, low = _unsigned(table, "high"), _unsigned(table, "low")
    levels, bits = build(high, low)
    order = np.argsort(lookup(levels, bits, high, low))
    largest = table.column("largest")
    arrays = [
        levels, bits, low[order], table.column("n").to_numpy()[order], largest.fill_null(0).to_numpy()[order],
        largest.is_valid().to_numpy()[order].astype(np.uint8),
    ]
    return pa.table([[table.column("shard")[0].as_py()], *([x.tobytes()] for x in arrays)], schema=pa.schema(
        [(f.name, pa.int64() if f.name == "shard" else pa.binary()) for f in ARRAYS.fields]
    ))


def index(hashes: DataFrame, least_documents: int) -> tuple[DataFrame, int]:
    """One row of ``ARRAYS`` for each shard that has any, over the distinct hashes of at least ``least_documents``
    documents, and the number of shards.

    Documents are told apart by doc_id; null is one document, smaller than all others.
    """
    ship_package(hashes.sparkSession)
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    counted = hashes.groupBy("high", "low").agg(documents.alias("n"), F.max("doc_id").alias("largest")).where(F.col("n") >= least_documents)
    counted = materialize(counted, "repeated-lines")
    shards = max(1, -(-counted.count() // SHARD))
    built = counted.withColumn("shard", F.pmod("high", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(_build_shard, ARRAYS)
    return materialize(built, "line-shards"), shards


def _probe_shard(probes, arrays):
    if not arrays.num_rows or not probes.num_rows:
        return pa.table([probes.column(c).slice(0, 0) for c in HASHES.names], names=HASHES.names)
    read = lambda column, kind: np.frombuffer(arrays.column(column)[0].as_py(), kind)
    high, low = _unsigned(probes, "high"), _unsigned(probes, "low")
    place = lookup(read("levels", np.int64), read("bits", np.uint64), high, low)
    known = (place >= 0) & (read("fingerprints", np.uint64)[place] == low)
    doc = probes.column("doc_id")
    named = read("named", np.uint8)[place] == 1
    holder = np.where(named, doc.is_valid().to_numpy() & (doc.fill_null(0).to_numpy() == read("largest", np.int64)[place]), True)
    return probes.filter(pa.array(known & ~holder)).select(HASHES.names)


def probe(hashes: DataFrame, arrays: DataFrame, shards: int) -> DataFrame:
    """Those of ``hashes`` that the arrays hold and whose doc_id is not the largest one."""
    shard = F.pmod("high", F.lit(shards).cast("long"))
    sizes = hashes.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes = materialize(sizes, "shard-sizes")
    # A key of a hot line is in one shard, its rows are in all of that shard's parts.
    dealt = hashes.withColumn("shard", shard).join(sizes, "shard")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "low"), F.col("parts")).cast("int")).drop("parts")
    copies = arrays.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe_shard, HASHES)


def drop_repeated_lines(docs: DataFrame, least_documents: int = 3, least_length: int = 20) -> DataFrame:
    """``docs`` without the lines that stand in ``least_documents`` documents or more, except in the largest doc_id that
    holds them, and with n_lines (before) and n_dropped (long); columns of these names give way.

    Lines are compared by their keys (``digests``). Documents are doc_ids: repeated rows of one doc_id count once and
    keep or lose a line together; rows with null doc_id are one document, smaller than all others. A null text counts as
    one empty line and comes back empty. An empty table gives an empty result. A text that loses all lines comes back
    empty.
    """
    hashes = materialize(line_hashes(docs, least_length), "line-hashes")
    found = probe(hashes, *index(hashes, least_documents))
    one = F.struct("high", "low")
    drops = materialize(found.groupBy("doc_id").agg(F.collect_list(one).alias("drops")), "dropped-lines")  # at most a text's own lines
    name, owner = T.fresh(docs.columns, "drops"), T.fresh([*docs.columns, "drops"], "owner")
    drops = drops.select(F.col("doc_id").alias(owner), F.col("drops").alias(name))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(f"`{owner}`")), "left").drop(owner)
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped")]
    schema = StructType([*(StructField("text", StringType()) if f.name == "text" else f for f in rest), StructField("n_lines", LongType()),
                         StructField("n_dropped", LongType())])

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            lists = batch.column(batch.schema.get_field_index(name))
            kept, n_lines, n_dropped = [], [], []
            for i, text in enumerate(texts):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                if lists[i].is_valid:
                    pairs = lists[i].values
                    both = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).tobytes()
                    gone = {both[a : a + 16] for a in range(0, len(both), 16)}
                    left = [line for line, digest in zip(text.split(b"\n"), digests(text, least_length)) if digest not in gone]
                    n_dropped[-1] = n_lines[-1] - len(left)
                    text = b"\n".join(left)
                kept.append(text)
            new = {"text": pa.array(kept, pa.binary()).view(pa.string()), "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
            columns = [new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(keep, schema)
