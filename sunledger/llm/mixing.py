"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by its weight. Shares above a source's cap (its size times the
largest number of epochs) are clamped there, and the excess goes to the other sources by weight until no
share is above its cap. Documents of a source are then repeated: a whole number of times each, and once
more for a seeded part of them. The part is chosen in the order of a seeded hash, in a few rounds so that
a long document does not keep those behind it out; running sizes are summed per hash bucket first, so a
source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.storage import materialize

from .texts import fresh

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix"
#: Hex digits of the hash that make a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: So often the hash order is gone through for documents that fit.
ROUNDS = 4
#: What a plan says of each round; LAST is behind every hash.
CUTS, LAST = "array<struct<gap:bigint,h:string,size:bigint>>", "g"

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with ``target``.

    The shares are min(cap, level * weight) for one level. Sources are filled in the order in which a
    rising level reaches their caps; the level is that of the first source it does not fill. Weights
    repeat in code-point order of the sources, null last. If all caps together are below the share, every
    source stops at its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    everything = Window.partitionBy(F.lit(0))
    rising = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    from_here = rising.rowsBetween(0, Window.unboundedFollowing)
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", epochs * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", left / F.sum("weight").over(from_here))
        # Up to the first source that is not filled, the level is at least cap / weight; from there on it is that source's.
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), True).over(whole))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, size: str, key: Column, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with struct ``mix``: source_size (long), target (double), times (int), taken (long).

    ``docs`` should be a stored table. ``size`` names its column of sizes (long, not null) and ``key`` is a
    string that orders repeated runs alike. A document is taken ``times`` times. Within a source, documents
    in hash order get the extra repetition up to the first one that does not fit into what the whole
    repetitions leave open. Those larger than the rest of the gap are then left out and the order is gone
    through again, at most ROUNDS times in all. Last, the one document whose size comes nearest to the
    remaining gap gets one too, if that brings the sum nearer. Rows with equal keys and sizes are one
    document in the rounds, and as many of them as come nearest are taken last. Empty documents, null sources and empty tables are fine.

    Only sizes and hashes are shuffled. The choice is a few hashes and sizes for each source, by which each
    row of ``docs`` is then judged where it is.
    """
    name = fresh(docs.columns, "mix")
    h = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    length = F.col(f"`{size}`").cast("long")
    rows = materialize(docs.select(F.col("source"), length.alias("size"), h.alias("h")), "mix-rows")
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    wanted = wanted.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)))
    extra = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    plan = materialize(wanted.select("*", extra.alias("gap"), F.array().cast(CUTS).alias("cuts")), "mix-plan")
    for _ in range(ROUNDS):
        if not plan.where("gap > 0").limit(1).count():
            break
        plan = materialize(_fill(rows, plan), "mix-plan")
    plan = materialize(_nearest(rows, plan), "mix-plan")
    names = {c: fresh([*docs.columns, name], c) for c in ("plan", "hash")}
    p, own = F.col(f"`{names['plan']}`"), F.col(f"`{names['hash']}`")
    hashed = docs.withColumn(names["hash"], h)
    joined = hashed.join(plan.select(F.struct(*plan.columns).alias(names["plan"])), F.col("source").eqNullSafe(p["source"]))
    one = F.coalesce((p["best"]["h"] == own) & (p["best"]["size"] == length), F.lit(False))
    if plan.where("best.k < best.n").limit(1).count():  # some, not all, of a row's repetitions: only those are numbered
        place = fresh(joined.columns, "place")
        order = Window.partitionBy("source", own, length).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        numbered = joined.where(one).withColumn(place, F.row_number().over(order))
        joined = numbered.union(joined.where(~one).withColumn(place, F.lit(0)))
        one = one & (F.col(f"`{place}`") <= p["best"]["k"])
    times = (p["whole"] + (_taken(p["cuts"], length, own) | one).cast("long")).cast("int")
    result = F.struct(p["source_size"].alias("source_size"), p["target"].alias("target"), times.alias("times"), (times * length).alias("taken"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), result.alias(name))


def _taken(cuts: Column, size: Column, h: Column) -> Column:
    """Whether some round took the row: it is not larger than the gap of the round, and not behind its cut."""
    return F.exists(cuts, lambda c: (size <= c["gap"]) & ((h < c["h"]) | ((h == c["h"]) & (size <= c["size"]))))


def _open(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """source, h, size, gap of the rows that no round took, in sources with a gap."""
    both = rows.alias("r").join(plan.where("gap > 0").alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    both = both.where(~_taken(F.col("p.cuts"), F.col("r.size"), F.col("r.h")))
    return both.select("r.source", "r.h", "r.size", "p.gap")


def _fill(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` after a round: each source with a gap gets one more cut (gap, h, size), and what is left of the gap.

    Sizes are summed by hash bucket in every task; only the rows of the bucket on which a source's cut falls are put in order.
    """
    rest = _open(rows, plan).where("size <= gap").withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = rest.groupBy("source", "bucket").agg(F.sum("size").alias("part"), F.first("gap").alias("gap"))
    upto = F.sum("part").over(Window.partitionBy("source").orderBy("bucket"))
    sums = materialize(sums.withColumn("before", upto - F.col("part")), "mix-sums")
    edge = sums.where("before <= gap AND before + part > gap").select("source", "bucket", "before")
    same = F.col("o.source").eqNullSafe(F.col("e.source")) & (F.col("o.bucket") == F.col("e.bucket"))
    inside = rest.alias("o").join(edge.alias("e"), same).select("o.*", "e.before")
    inside = inside.groupBy("source", "bucket", "before", "gap", "h", "size").agg(F.sum("size").alias("part"))
    upto = F.col("before") + F.sum("part").over(Window.partitionBy("source").orderBy("h", "size"))
    inside = inside.withColumn("upto", upto).withColumn("fits", F.col("upto") <= F.col("gap"))
    cut = inside.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.struct("h", "size"))), F.struct(F.first("bucket").alias("h"), F.lit(-1).cast("long").alias("size"))).alias("cut"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.first("before")).alias("filled"),
    )
    whole = sums.groupBy("source").agg(F.sum("part").alias("all"))
    found = whole.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("w.source").alias("source"), F.coalesce("c.filled", "w.all").alias("filled"),
        F.coalesce("c.cut", F.struct(F.lit(LAST).alias("h"), F.lit(0).cast("long").alias("size"))).alias("cut"),
    )
    own = F.struct(F.col("p.gap").alias("gap"), F.col("f.cut.h").alias("h"), F.col("f.cut.size").alias("size"))
    cuts = F.when(F.col("f.cut").isNull(), F.col("p.cuts")).otherwise(F.concat(F.col("p.cuts"), F.array(own)).cast(CUTS))
    named = plan.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
    left = F.col("p.gap") - F.coalesce("f.filled", F.lit(0))
    return named.select(*(F.col(f"p.{c}") for c in ("source", "source_size", "target", "whole")), left.alias("gap"), cuts.alias("cuts"))


def _nearest(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``best`` (h, size, k, n): k of the n rows of that hash and size come nearest to the remaining gap; null if
    nothing brings the sum nearer."""
    rest = _open(rows, plan).where("0 < size AND size < 2 * gap").groupBy("source", "gap", "h", "size").agg(F.count("*").alias("n"))
    k = F.least("n", F.greatest(F.lit(1), F.floor((2 * F.col("gap") + F.col("size")) / (2 * F.col("size")))))
    rest = rest.withColumn("k", k).withColumn("d", F.abs(F.col("k") * F.col("size") - F.col("gap"))).where("d < gap")
    best = rest.groupBy("source").agg(F.min(F.struct("d", "h", "size", "k", "n")).alias("best"))
    return plan.alias("p").join(best.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", "b.best")


def row_key(docs: DataFrame) -> Column:
    """A key for each document: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row of ``docs``."""
    sized = docs.select("doc_id", "source", n_words().alias("size"), row_key(docs).alias("key"))
    stored = materialize(sized, "mix-sizes")
    return mix(stored, "size", F.col("key"), **options).select("doc_id", "source", "size", "mix.*")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns."""
    name = fresh(docs.columns, "size")
    sized = docs.withColumn(name, n_words())
    mixed = mix(sized, name, row_key(docs), **options)
    times = F.col(f"`{fresh(sized.columns, 'mix')}`.times")
    return mixed.where(times > 0).withColumn(name, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
