"""Bands and problem classification, all as ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunledger import schema as S


def score_severity(score: Column, bands: list[tuple[float, str]] | None = None) -> Column:
    """Severity of an alert by its score; every bound is exclusive. Null scores count as 0."""
    value = F.coalesce(score, F.lit(0.0))
    return _ladder([(value < F.lit(b), label) for b, label in bands or S.SCORE_BANDS], S.LOW)


def batch_severity(score: Column, cut: Column) -> Column:
    """Alta up to and including the percentile cut, Normal above it, null without a score."""
    return F.when(score <= cut, S.BATCH_HIGH).when(score > cut, S.BATCH_NORMAL)


def rate_band(rate_percent: Column) -> Column:
    """Traffic light of an anomaly rate."""
    return _ladder([(rate_percent > F.lit(b), label) for b, label in S.RATE_BANDS], S.RATE_DEFAULT)


def current_problem(is_anomaly: Column, g: Column, c: Column, a: Column) -> Column:
    """Label of the current anomaly, null for a normal reading; the first match wins."""
    label = _ladder(
        [
            (g < c * F.lit(S.GENERATION_FAULT_SHARE), S.GENERATION_FAULT),
            (c > g * F.lit(S.EXCESS_CONSUMPTION_FACTOR), S.EXCESS_CONSUMPTION),
            (a / F.greatest(g, F.lit(1.0)) < F.lit(S.LOW_EFFICIENCY_BELOW), S.LOW_EFFICIENCY),
        ],
        S.GENERAL_ANOMALY,
    )
    return F.when(is_anomaly, label)


def future_problem(has_risk: Column, risk_score: Column) -> Column:
    """Label of the predicted problem, null without a risk."""
    label = _ladder(
        [
            (risk_score > F.lit(S.FUTURE_CRITICAL_ABOVE), S.FUTURE_CRITICAL),
            (risk_score > F.lit(S.FUTURE_HIGH_ABOVE), S.FUTURE_HIGH),
        ],
        S.FUTURE_MODERATE,
    )
    return F.when(has_risk, label)


def problem_severity(current: Column, future: Column) -> Column:
    """The graver of what the current and the predicted problem call for."""
    by_current = (
        F.when(current == S.GENERATION_FAULT, 3)
        .when(current == S.EXCESS_CONSUMPTION, 2)
        .when(current.isNotNull(), 1)
        .otherwise(0)
    )
    by_future = (
        F.when(future == S.FUTURE_CRITICAL, 3)
        .when(future == S.FUTURE_HIGH, 2)
        .when(future.isNotNull(), 1)
        .otherwise(0)
    )
    rank = F.greatest(by_current, by_future)
    return _ladder([(rank == r, name) for name, r in S.SEVERITY_RANK.items() if r > 0], S.LOW)


def problem_types(current: Column, future: Column) -> Column:
    """Array of the labels that apply, possibly empty."""
    return F.filter(F.array(current, future), lambda label: label.isNotNull())


def problem_description(current: Column, future: Column, risk_message: Column) -> Column:
    """Readable text of a problem, or the text of a normal reading when no label applies."""
    now = (
        F.when(current == S.GENERATION_FAULT, S.TEXT_GENERATION_FAULT)
        .when(current == S.EXCESS_CONSUMPTION, S.TEXT_EXCESS_CONSUMPTION)
        .when(current == S.LOW_EFFICIENCY, S.TEXT_LOW_EFFICIENCY)
        .when(current == S.GENERAL_ANOMALY, S.TEXT_GENERAL_ANOMALY)
    )
    suffix = (
        F.when(future == S.FUTURE_CRITICAL, S.TEXT_CRITICAL_SUFFIX)
        .when(future == S.FUTURE_HIGH, S.TEXT_HIGH_SUFFIX)
        .when(future == S.FUTURE_MODERATE, S.TEXT_MODERATE_SUFFIX)
    )
    later = F.concat(F.lit(S.TEXT_PREDICTION_PREFIX), risk_message, suffix)
    # A label always has a text; where both parts are null there is none.
    return F.when(now.isNull() & later.isNull(), S.TEXT_NORMAL).otherwise(F.concat_ws(S.TEXT_SEPARATOR, now, later))


def alert_type(is_anomaly: Column) -> Column:
    """Whether an alert reports a current anomaly or a prediction."""
    return F.when(is_anomaly, S.ALERT_CURRENT).otherwise(S.ALERT_PREDICTION)


def _ladder(rungs: list[tuple[Column, str]], default: str) -> Column:
    chain = F
    for condition, label in rungs:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))
