"""Scalar expressions over a reading: coercion, dates, identities and derived measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger import schema as S


def to_number(column: Column | str) -> Column:
    """Text to double; anything that is not a number becomes null."""
    text = F.trim(_col(column))
    number = text.try_cast("double")
    # The cast alone would also take Java's type suffixes and hexadecimal, and keep NaN.
    return F.when(~text.rlike(r"[0-9.][dDfF]$|[xX]") & ~F.isnan(number), number)


def to_date(column: Column | str) -> Column:
    """``dd.MM.yyyy`` text to date, row by row falling back to Spark's own timestamp parsing."""
    text = F.trim(_col(column))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(S.DATE_PARSE_FORMAT)).cast("date"),
        text.try_cast("timestamp").cast("date"),
    )


def to_date_strict(column: Column | str) -> Column:
    """``dd.MM.yyyy`` text to date, null for anything else."""
    return F.try_to_timestamp(F.trim(_col(column)), F.lit(S.DATE_PARSE_FORMAT)).cast("date")


def to_timestamp_iso(column: Column | str) -> Column:
    """ISO-8601 text to timestamp in the session's zone, null when it does not parse."""
    return _col(column).try_cast("timestamp")


def first_present(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first non-null among those of ``names`` that ``df`` has, else ``default``."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    if default is not None or not present:
        present.append(F.lit(default))
    return F.coalesce(*present)


def file_stem(path: Column | str) -> Column:
    """The file's name without folders and extension, URL escapes decoded."""
    escaped = F.replace(_col(path), F.lit("+"), F.lit("%2B"))  # a plus sign is not a blank in a path
    return F.regexp_extract(F.try_url_decode(escaped), r"([^/]+?)(?:\.[^./]+)?$", 1)


def source_name(path: Column | str) -> Column:
    """Source name from a file path: its folder, if that is named ``source=...``, else its stem without the common prefixes."""
    folder = F.nullif(F.regexp_extract(F.try_url_decode(_col(path)), rf"/{S.SOURCE_FOLDER}=([^/]+)/[^/]+$", 1), F.lit(""))
    name = F.coalesce(folder, file_stem(path))
    for prefix in S.SOURCE_PREFIXES:
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return name


def site_name(source: Column | str) -> Column:
    """Physical site of a source: drops the leading ``yy_mm_`` and the trailing date range."""
    bare = F.regexp_replace(_col(source), r"_\d{8}-\d{8}$", "")
    return F.regexp_replace(bare, r"^\d\d_\d\d_", "")


def calendar_columns(date: Column | str) -> dict[str, Column]:
    """Day of month, month, weekday (Monday = 0) and weekend flag."""
    d = _col(date)
    return {
        "day": F.dayofmonth(d),
        "month": F.month(d),
        "weekday": F.weekday(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def derived_columns(columns: list[str]) -> dict[str, Column]:
    """The four derived measures, each only where the columns it needs are among ``columns``."""
    g, c, a, export, imported = (F.col(m) for m in S.MEASURES)
    have = set(columns)
    out: dict[str, Column] = {}
    if {"generation_wh", "consumption_wh"} <= have:
        out["generation_consumption_ratio"] = F.try_divide(g, c + F.lit(S.RATIO_EPSILON))
        out["generation_consumption_diff"] = g - c
    if {"self_consumption_wh", "generation_wh"} <= have:
        out["self_consumption_efficiency"] = F.try_divide(a, g + F.lit(S.RATIO_EPSILON))
    if {"grid_export_wh", "grid_import_wh"} <= have:
        out["grid_balance"] = export - imported
    return out


def with_features(df: DataFrame, date: str = "reading_date") -> DataFrame:
    """Add calendar and derived feature columns, as far as their inputs exist."""
    added = calendar_columns(date) if date in df.columns else {}
    return df.withColumns({**added, **derived_columns(df.columns)})


def feature_names(df: DataFrame) -> list[str]:
    """The ordered feature list restricted to what ``df`` has."""
    return [f for f in S.FEATURES if f in df.columns]


def one_hot(source: Column | str, known: list[str], prefix: str = "Empresa_") -> dict[str, Column]:
    """One 0/1 column per known source; an unknown source is all zeros."""
    s = _col(source)
    return {f"{prefix}{k}": F.coalesce((s == F.lit(k)).cast("int"), F.lit(0)) for k in known}


def with_default_site(df: DataFrame, site: str, column: str = "source_id") -> DataFrame:
    """Add the site column where the table lacks it."""
    return df if column in df.columns else df.withColumn(column, F.lit(site))


def with_default_measures(df: DataFrame) -> DataFrame:
    """Absent or null measures count as 0, an absent site is the unknown site."""
    out = {}
    for m in S.MEASURES:
        out[m] = F.coalesce(F.col(m), F.lit(0.0)) if m in df.columns else F.lit(0.0)
    for s in ("source_id", "site_id"):
        if s in df.columns:
            out[s] = F.coalesce(F.col(s), F.lit(S.UNKNOWN_SITE))
    return df.withColumns(out)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows without generation or consumption."""
    return df.dropna(subset=["generation_wh", "consumption_wh"])


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
