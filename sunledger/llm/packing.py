"""Best-fit decreasing packing of token pieces into sequences.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths, which
has at most ``size`` entries whatever the number of documents: lengths are placed in decreasing order, a
run of equal ones at a time, always into the tightest open bins, found in logarithmic time by a segment
tree over remaining capacities. The decisions are a short table of intervals of bins. Each piece then
finds its place by its rank among the pieces of its length, which Spark counts in salted groups, so that
a length that a third of all pieces share is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunledger.storage import materialize

from . import tokens

SEQUENCE = 2048
END_ID = 0


class Capacities:
    """Segment tree over capacities 0..size: the smallest non-empty one that is at least a given length."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.filled = [False] * (2 * self.width)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _update(self, capacity: int) -> None:
        node = capacity + self.width
        self.filled[node] = bool(self.bins[capacity])
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        """Open bins ``first`` .. ``first + count - 1`` have this much room."""
        if count:
            self.bins[capacity].append((first, count))
            self._update(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        interval = self.bins[capacity].pop()
        self._update(capacity)
        return interval

    def tightest(self, length: int) -> int | None:
        node = length + self.width
        while not self.filled[node]:
            while node & 1:  # a right child: go up until there is something to the right
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.width:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.width


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths (1..size).

    Each row ``(length, low, high, bin, per_bin, offset)`` places the pieces of that length with rank
    low..high-1: rank r goes to bin ``bin + (r - low) // per_bin``, at
    ``offset + (r - low) % per_bin * length``. The same bins as placing the pieces one by one: after a
    piece went into the tightest bin, that bin is the tightest again as long as one more fits.
    """
    open_bins, opened, rows = Capacities(size), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = open_bins.tightest(length)
            if capacity is None:
                new = -(-left // (size // length))
                open_bins.add(size, opened, new)
                opened += new
                continue
            first, bins = open_bins.take(capacity)
            each = capacity // length
            full = min(bins, left // each)
            rest = min(left - full * each, each) if full < bins else 0
            if full:
                rows.append((length, rank, rank + full * each, first, each, size - capacity))
                open_bins.add(capacity - each * length, first, full)
                rank += full * each
            if rest:
                rows.append((length, rank, rank + rest, first + full, each, size - capacity))
                open_bins.add(capacity - rest * length, first + full, 1)
                rank += rest
            open_bins.add(capacity, first + full + bool(rest), bins - full - bool(rest))
            left = counts[length] - rank
    return rows


def best_fit(pieces: DataFrame, order: list[str], size: int = SEQUENCE, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long). ``pieces`` should be a stored table: it is read
    twice. ``order`` names the columns that tell pieces apart; rows equal in all of them and in length may
    take each other's place. Lengths must lie in 1..size. An empty table gives an empty result."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `size` rows
    if any(n is None or not 1 <= n <= size for n in counts):
        raise ValueError(f"piece lengths must lie in 1..{size}")
    rows = plan(counts, size)
    places = spark.createDataFrame(rows, f"`{length}` long, low long, high long, bin long, per_bin long, first_offset long").hint("broadcast")
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    group = Window.partitionBy(length, "_salt")
    before = (
        salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(length).orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    ranked = (
        salted.withColumn("_rank", F.row_number().over(group.orderBy(*order)).cast("long") - 1)
        .join(before, [length, "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    step = F.col("_rank") - F.col("low")
    placed = ranked.join(places, length).where((F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    return placed.select(
        *pieces.columns,
        (F.col("bin") + (step / F.col("per_bin")).cast("long")).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_bin") * F.col(length)).alias("offset"),
    )


def token_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END_ID, memory: int | None = None) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece (int), start, length (long), ids (binary, little-endian
    unsigned 32-bit). Null text counts as empty; an empty document is its end id alone. Repeated rows give
    repeated pieces; other columns are left out."""
    table = tokens.with_token_ids(docs.select("doc_id", "text"), "text", "token", path, end, memory)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(token.n - 1) div {size}"))).alias("p")
    return table.select("doc_id", "token", piece).select(
        "doc_id",
        F.col("p").cast("int").alias("piece"),
        (F.col("p") * size).alias("start"),
        F.least(F.col("token.n") - F.col("p") * size, F.lit(size).cast("long")).alias("length"),
        F.expr(f"substring(token.ids, cast(p * {4 * size} + 1 as int), {4 * size})").alias("ids"),
    )


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END_ID, keep_ids: bool = True, memory: int | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids (if ``keep_ids``), ids_crc32,
    sequence_id, offset. ``memory`` is the number of distinct words that a worker remembers."""
    pieces = token_pieces(docs, path, size, end, memory).withColumn("ids_crc32", F.crc32("ids"))
    stored = materialize(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return best_fit(stored, ["doc_id", "piece", "ids_crc32"], size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary). A group is one sequence, so its size is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda held, x: F.concat(held, x["ids"]))
    return (
        packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
        .select("sequence_id", "length", joined.alias("ids"))
    )

