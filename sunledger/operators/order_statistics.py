"""Exact percentiles, histograms, top-k and positional splits that no single task has to hold.

``percentile`` keeps every distinct value of a group in one buffer and a global ``row_number``
sorts the table in one task. The operators here reach the same results in narrow passes: a mergeable
sketch first says *where* the answer lies, then the rows around it are counted in ever finer ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from sunledger import schema as S
from sunledger.storage import materialize

# Size of a sketch. It misses a rank by about a thousandth of the rows; the bracket is wider than that.
SKETCH_SIZE = 4000
_BRACKET = 0.004
# Parts in which sketches are merged before the last merge, so no task receives one from every map task.
_SKETCH_PARTS = 64
# Ranges that the values in question are counted in, again and again until one value is left.
_RANGES = 4096


def exact_percentiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated percentiles as rows ``(*by, column, prob, value)``.

    Sketches bracket each wanted rank between two values. One more pass counts the rows below the
    brackets and, by value, those inside them, so repeated values collapse before the shuffle. The
    values inside are then counted in at most 4096 ranges a rank, and the range that holds the rank
    again, until it holds one value; nothing is sorted. Should a rank lie outside its bracket, the
    brackets are widened. ``df`` is read twice: pass a stored table where it is costly to
    compute. Nulls are left out, and so are groups with a null key.
    """
    width = _BRACKET
    while True:
        result, missed = _percentiles(df, columns, probs, by or [], width)
        if not missed:
            return result
        width *= 8


def _percentiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str], width: float) -> tuple[DataFrame, bool]:
    parts = df.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(_SKETCH_PARTS)).alias("_part")).agg(
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_SIZE)).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    merged = parts.groupBy(*by).agg(
        *[F.kll_merge_agg_double(f"_s{i}").alias(f"_s{i}") for i in range(len(columns))],
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))],
    )

    # Widths of the bracket: the first one that leaves two more ranks than the sketch's error on either side.
    steps = [width * 8**k for k in range(8) if width * 8 ** (k - 1) < 1 or k == 0]

    def quantiles(i: int) -> Column:
        ends = [e for w in steps for p in probs for e in (max(p - w, 0.0), min(p + w, 1.0))]
        every = F.kll_sketch_get_quantile_double(f"_s{i}", F.array(*map(F.lit, ends)))
        fits = [F.lit(width) + F.lit(2.0) / F.col(f"_n{i}") <= 2 * w for w in steps[:-1]]
        step = F.coalesce(*(F.when(f, F.lit(k)) for k, f in enumerate(fits)), F.lit(len(steps) - 1))
        return F.when(F.col(f"_n{i}") > 0, F.slice(every, step * (2 * len(probs)) + 1, 2 * len(probs))).alias(f"_q{i}")

    # Written once because two passes use them. Catalyst broadcasts the table of brackets only if its
    # file is small; without groups it is a single row.
    brackets = materialize(merged.select(*by, *[quantiles(i) for i in range(len(columns))], *[f"_n{i}" for i in range(len(columns))]), "brackets")
    if by:
        bracketed = df.select(*by, *columns).join(brackets, by)
    else:
        bracketed = df.select(*columns).crossJoin(F.broadcast(brackets))

    # One row for each value, so that the code that compares it with its brackets is that of one column: compiled code
    # for all columns at once grows beyond what the JVM optimises. A value in a bracket is counted by itself (repeated
    # ones collapse before the shuffle), any other one by which brackets it lies below (a bit for each).
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)]))
    inside = " OR ".join(f"v BETWEEN q[{2 * j}] AND q[{2 * j + 1}]" for j in range(len(probs)))
    under = F.expr(f"CASE WHEN NOT ({inside}) THEN array({', '.join(f'v < q[{2 * j}]' for j in range(len(probs)))}) END")
    single = bracketed.select(*by, values.alias("t")).select(*by, "t.c", "t.v", "t.q").where("v IS NOT NULL")
    counted = single.select(*by, "c", F.expr(f"CASE WHEN {inside} THEN v END").alias("v"), under.alias("under"))
    counted = materialize(counted.groupBy(*by, "c", "v", "under").agg(F.count(F.lit(1)).alias("k")), "counted")
    # What lies below a target's bracket without being kept: kept values are counted one by one.
    below = counted.where("under IS NOT NULL").groupBy(*by, "c").agg(
        F.array(*[F.sum(F.when(F.col("under")[j], F.col("k")).otherwise(0)) for j in range(len(probs))]).alias("below")
    )
    counted = counted.where("under IS NULL").drop("under")
    targets = ", ".join(
        f"named_struct('c', {i}, 'p', {j}, 'n', _n{i}, 'low', _q{i}[{2 * j}], 'high', _q{i}[{2 * j + 1}])" for i in range(len(columns)) for j in range(len(probs))
    )
    offsets = brackets.dropna(subset=by) if by else brackets
    offsets = offsets.select(*by, F.expr(f"inline(array({targets}))")).where("n > 0").join(below, [*by, "c"], "left")
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("p") + 1)
    position = prob * (F.col("n") - 1)
    lower = F.coalesce(F.element_at("below", F.col("p") + 1), F.lit(0))
    wanted = F.explode(F.array(F.struct(F.lit(0).alias("upper"), F.floor(position).alias("at")), F.struct(F.lit(1).alias("upper"), F.ceil(position).alias("at"))))
    targets = offsets.withColumn("w", wanted).select(
        *by, "c", "p", F.col("w.upper").alias("upper"), (F.col("w.at") - lower).alias("rank"), "low", "high", (position - F.floor(position)).alias("part")
    )
    found = _values_at(counted, materialize(targets, "targets"), by)
    picked = materialize(
        found.groupBy(*by, "c", "p").agg(
            F.max(F.when(F.col("upper") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("upper") == 1, F.col("v"))).alias("v1"),
            F.max("part").alias("part"), F.bool_or(F.col("v").isNull() | ~F.col("v").between(F.col("low"), F.col("high"))).alias("missed"),
        ),
        "picked",
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    value = F.col("v0") + F.when(F.col("part") > 0, (F.col("v1") - F.col("v0")) * F.col("part")).otherwise(0.0)
    result = picked.select(*by, name.alias("column"), prob.alias("prob"), value.alias("value"))
    return result, not picked.where("missed").isEmpty()


def _values_at(counted: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The targets with ``v``: the value of 0-based ``rank`` among the counted values ``(*by, c, v, k)``; null beyond them."""
    group, key = [*by, "c"], [*by, "c", "p", "upper"]
    ends = counted.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = targets.select(*key, "rank").join(ends, group)
    done: DataFrame | None = None
    span = F.col("hi") - F.col("lo")
    even = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), span), F.lit(0.0)) * _RANGES), F.lit(_RANGES - 1))
    # Infinite ends have no width: they are set apart from what lies between them.
    ends_apart = F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), 2).otherwise(1)
    number = F.when(span < float("inf"), even).otherwise(ends_apart).cast("int")
    while True:
        inside = counted.join(materialize(state, "ranges"), group).where(F.col("v").between(F.col("lo"), F.col("hi")))
        ranges = inside.groupBy(*key, "rank", number.alias("range")).agg(F.sum("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most 4096 rows for each target.
        upto = F.sum("k").over(Window.partitionBy(*key).orderBy("range"))
        held = ranges.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
        held = materialize(held.select(*key, (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "lo", "hi"), "held")
        single = held.where("lo = hi").select(*key, F.col("lo").alias("v"))
        done = single if done is None else done.unionByName(single)
        state = held.where("lo < hi")
        if state.isEmpty():
            return targets.join(done, key, "left")


def percentile_row(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    """The named percentiles of one column as a single row."""
    rows = exact_percentiles(df, [column], list(probs.values()))
    return rows.agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in probs.items()]
    )


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a table that is one row by construction (an ungrouped aggregate)."""
    return df.crossJoin(F.broadcast(one_row))


def histogram(df: DataFrame, column: str, bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over min..max: ``bin`` (1..bins), its bounds and ``rows``; empty bins too. No rows without a value."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    width = (hi - lo) / F.lit(bins)
    # A constant column has no width; everything is then in the first bin.
    # The quotient may miss an edge by one rounding; the edges themselves decide.
    near = F.least(F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * bins), F.lit(bins - 1))
    below, above = x < lo + near * width, (x >= lo + (near + 1) * width) & (near < bins - 1)
    number = F.when(hi == lo, F.lit(1)).otherwise(near + 1 - below.cast("int") + above.cast("int"))
    filled = (
        with_scalar(df.where(x.isNotNull()).select(column), ends)
        .groupBy(number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    every = ends.where(lo.isNotNull()).select("_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("lower"),
        (lo + F.col("bin") * width).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    The rank is taken per salted part of the group first, so a hot group is ranked by many tasks
    and the second rank sees at most ``k`` rows of each part. Where a group's rows lie together in the files, few tasks
    read them: without salts each task keeps its first ``k`` rows of a group (up to the thousand for which Spark plans
    that), and only those are shuffled.
    """
    if salts == 0:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("_rank") <= k).drop("_rank")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )


def newest(df: DataFrame, order: list[str], k: int = S.RETENTION_ROWS) -> DataFrame:
    """The ``k`` newest rows of the whole table; each task keeps only its own best ``k``."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``position`` (0-based) in the total order ``order`` without a one-task window.

    A range-partitioned sort is written once; a row's position is its offset within its partition
    plus the rows in the partitions before it.
    """
    columns = df.columns
    ordered = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")
    )
    ordered = materialize(ordered, "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, of which there are at most as many as shuffle partitions.
    starts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    offset = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(starts), "_part").select(
        *columns, (F.col("_start") + offset).alias("position")
    )


def split_by_position(
    df: DataFrame, first_share: float, date: str, tie_break: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The first ``floor(n * first_share)`` rows in (date, tie_break) order, and the rest.

    Row counts per date find the date the cut falls on; only that date's rows are then ordered.
    """
    if not isinstance(df.schema[date].dataType, DateType):
        raise ValueError(f"{date} must be a date: there is one row per day in the running total")
    # A few rows per calendar day: the running total needs one small task.
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("rows"))
    running = days.select(
        F.col(date).alias("day"),
        F.sum("rows").over(Window.orderBy(F.asc_nulls_first(date))).alias("upto"),
        F.col("rows"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.floor(F.col("total") * F.lit(first_share) + F.lit(1e-9))
    cut = running.where((F.col("upto") > wanted) & (F.col("upto") - F.col("rows") <= wanted)).select(
        "day", (wanted - (F.col("upto") - F.col("rows"))).alias("take")
    )
    row = cut.first()
    if row is None:
        return df, df.limit(0)
    d, day = F.col(date), F.lit(row["day"]).cast(df.schema[date].dataType)
    same = d.eqNullSafe(day)
    before_cut = F.coalesce((d < day) | (d.isNull() & day.isNotNull()), F.lit(False))
    on_cut = with_position(df.where(same), tie_break)
    train = df.where(before_cut).unionByName(on_cut.where(F.col("position") < row["take"]).drop("position"))
    rest = df.where(~before_cut & ~same).unionByName(on_cut.where(F.col("position") >= row["take"]).drop("position"))
    return train, rest

