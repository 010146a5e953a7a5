"""Retraining, parameter search, validation and comparison of normalisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.operators import reports, sets
from sunledger.operators.order_statistics import exact_percentiles, split_by_position
from sunledger.plans.model import AnomalyModel, fit, train, train_and_decide
from sunledger.sinks.tables import append
from sunledger.sources.history import read_store
from sunledger.storage import materialize

ORDER = ["source_id"]


def retrain(
    store_path: str, new_readings: DataFrame, old: AnomalyModel | None = None, contamination: float | None = None
) -> AnomalyModel:
    """Train on the stored history plus new readings, then add the new ones to the store.

    Contamination, normalisation, trees, sample size and seed are the old model's, if there is one. The combined rows are written before training, so the append cannot change what is trained on.
    """
    spark = new_readings.sparkSession
    history = read_store(spark, store_path)
    combined = new_readings if history is None else sets.union_sites([history, new_readings])
    if contamination is None:
        contamination = old.params["contamination"] if old else S.CONTAMINATION
    options = {k: old.params[k] for k in ("normalization", "legacy_order", "site_aware", "n_trees", "seed")} if old else {}
    model = train(materialize(combined, "combined"), contamination=contamination, **options)
    append(new_readings, store_path)
    return model


def validate(model: AnomalyModel, readings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Validation statistics as one row; with known anomalies also precision, recall and F1."""
    scored = model.predict(readings)
    if known is not None:
        scored = materialize(scored, "scored")
    return validation_metrics(scored, known)


def validation_metrics(scored: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The metrics of rows that are scored already."""
    stats = reports.validation_stats(scored)
    if known is None:
        return stats
    return stats.crossJoin(F.broadcast(sets.confusion(scored.where("is_anomaly"), known)))  # one row each


def train_with_validation(
    readings: DataFrame,
    contamination: float = S.CONTAMINATION,
    validation_split: float = S.VALIDATION_SPLIT,
    tie_break: list[str] | None = None,
) -> tuple[AnomalyModel, DataFrame]:
    """Train on the earlier rows and validate on the later ones."""
    first, rest = split_by_position(readings, 1 - validation_split, "reading_date", tie_break or ORDER)
    model = train(first, contamination=contamination)
    return model, validate(model, rest)


def grid_search(
    readings: DataFrame,
    contaminations: list[float] | None = None,
    tree_counts: list[int] | None = None,
    validation_split: float = S.VALIDATION_SPLIT,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """Mean validation score and anomaly rate of every parameter pair, one row each.

    One forest of the largest size is trained: a smaller one is its first trees. Each row is scored
    once for all sizes, and one percentile job finds the thresholds of all pairs.
    """
    contaminations = contaminations or S.GRID_CONTAMINATION
    tree_counts = tree_counts or S.GRID_TREES
    first, rest = split_by_position(readings, 1 - validation_split, "reading_date", tie_break or ORDER)
    first = materialize(first, "train")
    model = fit(first, n_trees=max(tree_counts), site_aware=False)
    columns = [f"score_{k}" for k in tree_counts]

    train_scores = materialize(model.score(first, prefixes=tree_counts).select(*columns), "scores")
    cuts = exact_percentiles(train_scores, columns, contaminations)
    # One row per pair, twelve by default: the grid is an argument, not data.
    thresholds = {(r["column"], r["prob"]): r["value"] for r in cuts.collect()}

    cells = []
    for k in tree_counts:
        score = F.col(f"score_{k}")
        for share in contaminations:
            detected = F.count_if(score < F.lit(thresholds[(f"score_{k}", share)]))
            cells.append(
                F.struct(
                    F.lit(share).alias("contamination"),
                    F.lit(k).alias("n_estimators"),
                    F.avg(score).alias("mean_score"),
                    F.coalesce(F.try_divide(detected.cast("double"), F.count(score)), F.lit(0.0)).alias("anomaly_rate"),
                    detected.alias("num_anomalies"),
                )
            )
    scored = model.score(rest, prefixes=tree_counts).select(*columns)
    return scored.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def best_parameters(grid: DataFrame) -> DataFrame:
    """The pair with the highest mean score; the score ignores the contamination, so ties take the smallest."""
    return grid.orderBy(F.desc("mean_score"), "contamination", "n_estimators").limit(1)


def compare_normalizations(
    readings: DataFrame, contamination: float = S.CONTAMINATION, methods: list[str] | None = None
) -> DataFrame:
    """Anomalies and their share under each normalisation, one row per method. Each model scores the readings once."""
    scored = [
        train_and_decide(readings, contamination=contamination, normalization=m)[1]
        .select(F.lit(m).alias("method"), "is_anomaly")
        for m in methods or S.NORMALIZATIONS
    ]
    return (
        reduce(DataFrame.unionAll, scored)
        .groupBy("method")
        .agg(
            F.count_if("is_anomaly").alias("anomalies"),
            (F.avg(F.col("is_anomaly").cast("int")) * 100).alias("percentage"),
        )
    )
