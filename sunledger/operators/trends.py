"""Trends of a site's recent history and the risk they imply.

The history of a reading is the site's last seven earlier readings. With one reading per site and
day (``one_reading_per_day``) a site's group is bounded by the number of calendar days, so one
window over the site is safe whatever the size of the table. Series keyed by a timestamp have no
such bound: pass ``chunk_seconds`` and each site's timeline is cut into pieces that each carry the
seven rows before them, which gives the same rows while no task ever holds a whole site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.storage import materialize

SERIES = {"generation": "generation_wh", "consumption": "consumption_wh", "efficiency": "_eff"}
_HISTORY_MEASURES = ["generation_wh", "consumption_wh", "self_consumption_wh"]


def one_reading_per_day(df: DataFrame) -> DataFrame:
    """One row per site and date, whichever sources repeat it: of differing ones the smallest. Rows without a date stay.

    Only sites and dates are shuffled to find those that are repeated, combined in every task, and then the rows of these;
    all others pass as they are. ``df`` is read twice, and once more where there are repeated ones.
    """
    keys = ["site_id", "reading_date"]
    rest = [c for c in df.columns if c not in keys]
    rows = df.where(F.col("reading_date").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = rows.where("_rows > 1").select(F.col("site_id").alias("_site"), F.col("reading_date").alias("_day"))
    repeated = materialize(repeated, "repeated-days")
    same = F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("reading_date") == F.col("_day"))
    kept = df.join(repeated, same, "left_semi").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row"))
    kept = kept.select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in df.columns])
    return df.join(repeated, same, "left_anti").unionAll(kept)


def analyze_trends(
    df: DataFrame,
    order_by: list[str] | None = None,
    chunk_seconds: int | None = None,
    site: str = "site_id",
) -> DataFrame:
    """Add trend, speed, current change, recent values, degradation and risk to every row.

    ``order_by`` is the total order of a site's readings (``reading_date`` by default). With
    ``chunk_seconds`` its first column must be a date or a timestamp; choose the length so that the
    busiest chunk of a site still suits one task.
    """
    order_by = order_by or ["reading_date"]
    df = df.withColumns({m: F.coalesce(F.col(m), F.lit(0.0)) for m in _HISTORY_MEASURES})
    if chunk_seconds is None:
        return _risk(_trend_windows(df, [site], order_by))
    pieces = _with_preceding_rows(df, site, order_by, chunk_seconds)
    analyzed = _risk(_trend_windows(pieces, [site, "_chunk"], order_by))
    return analyzed.where(~F.col("_carried")).drop("_chunk", "_carried")


def _trend_windows(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """All history measures, from two windows that share one partitioning and one sort.

    The second one hands each row the changes, yields and values of the rows before it as columns: a sliding frame
    would go through its rows again for each reading and measure.
    """
    running = Window.partitionBy(*keys).orderBy(*order_by)
    g, a = F.col("generation_wh"), F.col("self_consumption_wh")
    kept = df.columns

    df = df.withColumn("_eff", a / F.greatest(g, F.lit(1.0)))
    step = {
        f"_chg_{name}": relative_change(F.lag(value).over(running), F.col(value))
        for name, value in SERIES.items()
    }
    step["_yield"] = F.when(g > 0, F.try_divide(a, g))
    df = df.withColumns(step)

    def earlier(column: str, reach: int) -> list[str]:
        """Names of the column's values in the ``reach`` rows before, the oldest first; null where there is no such row."""
        return [f"_{k}_{column}" for k in range(reach, 0, -1)]

    reach = {**{f"_chg_{n}": S.HISTORY_ROWS - 1 for n in SERIES}, "_yield": S.HISTORY_ROWS, **{v: S.RECENT_VALUES for v in SERIES.values()}}
    lags = {f"_{k}_{c}": F.lag(c, k).over(running) for c, far in reach.items() for k in range(1, far + 1)}
    rows = F.least(F.row_number().over(running) - 1, F.lit(S.HISTORY_ROWS)).cast("long")
    df = df.withColumns({**lags, "history_rows": rows})

    yields = [F.col(c) for c in earlier("_yield", S.HISTORY_ROWS)]
    measures = {"degradation_slope": F.when(_known(yields) >= S.MIN_DEGRADATION_ROWS, _slope(yields))}
    for name, value in SERIES.items():
        measures[f"_mean_{name}"] = _mean([F.col(c) for c in earlier(f"_chg_{name}", S.HISTORY_ROWS - 1)])
        # The values are never null. A lambda keeps this projection out of one generated method, which would be too long
        # for the JVM to compile; its expressions are generated as methods of their own.
        measures[f"_recent_{name}"] = F.filter(F.array(*earlier(value, S.RECENT_VALUES)), lambda x: x.isNotNull())
    last = {f"_last_{name}": F.col(f"_1_{value}") for name, value in SERIES.items()}
    df = df.select(*kept, "_eff", "history_rows", *[c.alias(n) for n, c in {**measures, **last}.items()])

    columns: dict[str, Column] = {c: F.col(c) for c in ("history_rows", "degradation_slope")}
    for name, value in SERIES.items():
        own = (F.col(f"_{part}_{name}") for part in ("mean", "last"))
        columns.update(series_trend(name, F.col("history_rows"), *own, F.col(value), F.col(f"_recent_{name}")))
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def _known(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def _mean(values: list[Column]) -> Column:
    """Mean of the known ones, added in their order as ``avg`` adds them; null if none is known."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.try_divide(total, _known(values).cast("double"))


def _slope(values: list[Column]) -> Column:
    """Least-squares slope of the known ones over their positions 0, 1, ... among themselves."""
    n = _known(values).cast("double")
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    weighted = sum((F.coalesce(v * _known(values[:i]), F.lit(0.0)) for i, v in enumerate(values)), F.lit(0.0))
    return F.try_divide(weighted - total * (n - 1) / 2, n * (n * n - 1) / 12)


def series_trend(
    name: str, rows: Column, mean: Column, last: Column, current: Column, recent: Column
) -> dict[str, Column]:
    """Label, speed, current change and recent values from a series' mean change."""
    known = mean.isNotNull() & (rows >= 2)
    label = (
        F.when(rows < 2, S.INSUFFICIENT)
        .when(mean > F.lit(S.TREND_BAND), S.RISING)
        .when(mean < F.lit(-S.TREND_BAND), S.FALLING)
        .otherwise(S.STABLE)
    )
    change = F.when(last > 0, (current - last) / F.greatest(last, F.lit(1.0))).otherwise(0.0)
    return {
        f"{name}_trend": label,
        f"{name}_speed": F.when(known, F.abs(mean)).otherwise(0.0),
        f"{name}_change": F.when(known, change),
        f"{name}_recent": F.when(known, recent),
    }


def relative_change(previous: Column, value: Column) -> Column:
    """Change relative to the previous value, null unless that value is positive."""
    return F.when(previous > 0, (value - previous) / previous)


def risk_findings(df: DataFrame) -> DataFrame:
    """The trend columns and each finding (``_found_0`` ...) and their total weight (``_total``) as columns of their own.

    Score, flag and message read them several times; spelt out in each, their code grows beyond what the JVM optimises.
    """
    findings = [
        _moving("consumption", S.RISING, S.CONSUMPTION_SPEED),
        _moving("generation", S.FALLING, S.GENERATION_SPEED),
        _moving("efficiency", S.FALLING, S.EFFICIENCY_SPEED),
        # Rounded, so that a slope of exactly the limit is not decided by the last bit of a sum.
        F.round("degradation_slope", 12) < F.lit(S.DEGRADATION_SLOPE),
    ]
    found = df.withColumns({f"_found_{i}": f for i, f in enumerate(findings)})
    total = _decimal("0.0")
    for i, weight in enumerate([S.CONSUMPTION_WEIGHT, S.GENERATION_WEIGHT, S.EFFICIENCY_WEIGHT, S.DEGRADATION_WEIGHT]):
        total = total + F.when(F.col(f"_found_{i}"), _decimal(weight)).otherwise(_decimal("0.0"))
    return found.withColumn("_total", total)


def risk_columns() -> dict[str, Column]:
    """Risk score, flag, confidence and message from the columns of ``risk_findings``."""
    enough = F.col("history_rows") >= S.MIN_HISTORY
    total = F.col("_total")
    texts = [S.RISK_CONSUMPTION, S.RISK_GENERATION, S.RISK_EFFICIENCY, S.RISK_DEGRADATION]
    message = F.concat_ws(S.RISK_SEPARATOR, *[F.when(F.col(f"_found_{i}"), F.lit(t)) for i, t in enumerate(texts)])
    return {
        "risk_score": F.when(enough, total.cast("double")).otherwise(0.0),
        "has_risk": enough & (total > _decimal(S.RISK_ABOVE)),
        "confidence": F.when(
            enough, F.least(F.col("history_rows") / F.lit(float(S.HISTORY_ROWS)), F.lit(1.0))
        ).otherwise(0.0),
        # Every finding has a weight, so without any the total is 0.
        "risk_message": F.when(~enough, S.RISK_INSUFFICIENT).when(total == 0, S.RISK_NONE).otherwise(message),
    }


def _risk(df: DataFrame) -> DataFrame:
    return risk_findings(df).withColumns(risk_columns()).drop("_total", *[f"_found_{i}" for i in range(4)])


def _moving(name: str, label: str, speed: float) -> Column:
    return (F.col(f"{name}_trend") == label) & (F.col(f"{name}_speed") > F.lit(speed))


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(3,1)")


def _with_preceding_rows(df: DataFrame, site: str, order_by: list[str], chunk_seconds: int) -> DataFrame:
    """Cut each site into time chunks and copy into each chunk the seven rows that precede it.

    The copies come from a summary of at most seven rows per chunk; seven earlier chunks always
    hold at least seven rows, so the summary window needs no more than that.
    """
    chunk = F.floor(F.unix_seconds(F.col(order_by[0]).cast("timestamp")) / F.lit(chunk_seconds)).cast("long")
    df = df.withColumn("_chunk", chunk)
    carried_columns = list(dict.fromkeys([site, *order_by, *_HISTORY_MEASURES]))
    newest = Window.partitionBy(site, "_chunk").orderBy(*[F.desc(c) for c in order_by])
    row = F.struct(*order_by, *[c for c in carried_columns if c not in order_by and c != site])
    tails = (
        df.select("_chunk", *carried_columns)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= S.HISTORY_ROWS)
        .groupBy(site, "_chunk")
        .agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    )
    earlier = Window.partitionBy(site).orderBy("_chunk").rowsBetween(-S.HISTORY_ROWS, -1)
    carried = (
        tails.select(site, "_chunk", F.flatten(F.collect_list("_tail").over(earlier)).alias("_rows"))
        .where(F.size("_rows") > 0)
        .select(site, "_chunk", F.explode(F.slice("_rows", -F.least(F.size("_rows"), F.lit(S.HISTORY_ROWS)), S.HISTORY_ROWS)).alias("_row"))
        .select(site, "_chunk", "_row.*")
    )
    return df.withColumn("_carried", F.lit(False)).unionByName(
        carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True
    )
