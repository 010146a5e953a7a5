"""Training, scoring and storing of the anomaly model."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.functions.readings import with_features
from sunledger.functions.severity import batch_severity
from sunledger.operators import reports
from sunledger.operators.forest import fit_forest, score_forest, share_forest
from sunledger.operators.order_statistics import percentile_row, with_scalar
from sunledger.operators.scaling import apply_scaler, fit_scaler
from sunledger.storage import Versions, materialize

_INPUT = "__x"


@dataclass(frozen=True)
class AnomalyModel:
    """A trained model: its tables and its parameters.

    ``threshold`` is the training scores' percentile at the contamination: a lower score is an
    anomaly. ``severity_cut`` is their tenth percentile.
    """

    nodes: DataFrame
    scaler: DataFrame
    profiles: DataFrame
    params: dict = field(default_factory=dict)
    feature_scaler: DataFrame | None = None
    # The packed nodes, sent to the executors once for all batches that the model scores.
    _shared: dict = field(default_factory=dict, repr=False, compare=False)

    def score(self, readings: DataFrame, prefixes: list[int] | None = None) -> DataFrame:
        """The readings with their ``score``; null where a feature is missing."""
        features = self.params["features"]
        prepared = _scaled_inputs(readings, self.params, self.scaler, self.feature_scaler)
        if "forest" not in self._shared:
            self._shared["forest"] = share_forest(self.nodes, len(features), self.params["psi"])
        scored = score_forest(
            prepared,
            self.nodes,
            [f + _INPUT for f in features],
            self.params["psi"],
            source="source_id" if self.params["site_aware"] and "source_id" in readings.columns else None,
            prefixes=prefixes,
            shared=self._shared["forest"],
        )
        return scored.drop(*[f + _INPUT for f in features])

    def predict(self, readings: DataFrame) -> DataFrame:
        """The readings with ``score`` and ``is_anomaly``."""
        return self.score(readings).withColumn("is_anomaly", decide(F.col("score"), self.params["threshold"]))

    def get_anomalies(
        self, readings: DataFrame, percentile: float = S.SEVERITY_PERCENTILE, severity_from: str = "batch"
    ) -> DataFrame:
        """The readings with ``score``, ``is_anomaly`` and ``severity``.

        ``severity_from="batch"`` cuts at the batch's own percentile. An incremental job uses
        ``"training"``: a one-row batch would always be severe by its own percentile.
        """
        predicted = self.predict(readings)
        if severity_from == "training":
            return predicted.withColumn("severity", batch_severity(F.col("score"), F.lit(self.params["severity_cut"])))
        # Scores are costly and read by the percentile and by the caller.
        predicted = materialize(predicted, "scored")
        return add_batch_severity(predicted, percentile)

    def save(self, path: str) -> int:
        """Store the model as a new version under ``path``, which may be the one it was loaded from; returns its number.

        A version is a folder of Parquet tables that is never written to again. It counts once a record names it,
        which is written last: until then, and if this fails, the version before it is the model.
        """
        spark = self.nodes.sparkSession
        params, root = {k: v for k, v in self.params.items()}, path.rstrip("/")
        folder = f"version-{uuid.uuid4().hex}"
        path = f"{root}/{folder}"
        self.nodes.write.parquet(f"{path}/nodes")
        self.scaler.write.parquet(f"{path}/scaler")
        self.profiles.write.parquet(f"{path}/profiles")
        if self.feature_scaler is not None:
            self.feature_scaler.write.parquet(f"{path}/feature_scaler")
        spark.createDataFrame([params], _PARAMS).coalesce(1).write.parquet(f"{path}/params")
        # Each known source is a feature of a site-aware model; they are kept as a table, not as a list of names.
        known = 0
        if params["site_aware"]:
            self.profiles.select("source_id").write.parquet(f"{path}/sources")
            known = spark.read.parquet(f"{path}/sources").count()
        metadata = {
            "trained_date": params["trained_date"],
            "contamination": params["contamination"],
            "num_features": len(params["features"]) + known,
            "features": [S.FEATURE_LABELS.get(f, f) for f in params["features"]],
        }
        schema = "trained_date string, contamination double, num_features int, features array<string>"
        spark.createDataFrame([metadata], schema).coalesce(1).write.json(f"{path}/metadata")
        versions = Versions(spark, f"{root}/_versions")
        number = max(versions.numbers(), default=0) + 1
        versions.publish(number, {"folder": folder})
        return number

    @staticmethod
    def folder(spark: SparkSession, path: str, version: int | None = None) -> str:
        """Where the tables of a version are (by default of the newest)."""
        versions = Versions(spark, f"{path.rstrip('/')}/_versions")
        if version is None:
            record = (versions.latest() or (0, None))[1]
        else:
            record = versions.record(version) if version in versions.numbers() else None
        if record is None:
            raise FileNotFoundError(f"no model at {path}" + ("" if version is None else f" with version {version}"))
        return f"{path.rstrip('/')}/{record['folder']}"

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> AnomalyModel:
        path = cls.folder(spark, path, version)
        table = lambda name: spark.read.parquet(f"{path}/{name}")
        params = table("params").first().asDict(recursive=True)
        extra = table("feature_scaler") if params["legacy_order"] else None
        return cls(table("nodes"), table("scaler"), table("profiles"), params, extra)


_PARAMS = (
    "trained_date string, contamination double, features array<string>, normalization string, "
    "legacy_order boolean, site_aware boolean, n_trees int, psi int, seed long, rows long, "
    "threshold double, severity_cut double"
)


def decide(score: Column, threshold: Column | float) -> Column:
    """An anomaly scores strictly below the threshold; a row without a score is none."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(score < limit, F.lit(False))


def add_batch_severity(scored: DataFrame, percentile: float = S.SEVERITY_PERCENTILE) -> DataFrame:
    """Add ``severity`` by the batch's own score percentile."""
    cut = percentile_row(scored, "score", {"_cut": percentile})
    marked = with_scalar(scored, cut)
    return marked.withColumn("severity", batch_severity(F.col("score"), F.col("_cut"))).drop("_cut")


def train(readings: DataFrame, contamination: float = S.CONTAMINATION, **options) -> AnomalyModel:
    """Fit a forest and set its thresholds. ``options`` are those of ``fit``.

    The table is scanned several times, so pass one that is stored.
    """
    return calibrate(fit(readings, **options), readings, contamination)


def train_and_decide(readings: DataFrame, contamination: float = S.CONTAMINATION, **options) -> tuple[AnomalyModel, DataFrame]:
    """The model of ``train`` and its ``score`` and ``is_anomaly`` of each reading it was trained on.

    What ``predict`` returns for them, without its other columns, from the scores that the thresholds were set by.
    """
    model, scores = _calibrated(fit(readings, **options), readings, contamination)
    return model, scores.withColumn("is_anomaly", decide(F.col("score"), model.params["threshold"]))


def fit(
    readings: DataFrame,
    normalization: str = "global",
    n_trees: int = S.N_TREES,
    max_samples: int = S.MAX_SAMPLES,
    seed: int = S.SEED,
    site_aware: bool = True,
    legacy_order: bool = False,
    key: list[str] | None = None,
) -> AnomalyModel:
    """Fit scaler and forest; the model scores, but has no thresholds yet.

    Features come from raw readings and are scaled once. ``legacy_order`` scales the measures first,
    derives the ratios from the scaled ones and scales all features again.
    """
    key = key or ["source_id", "reading_date"]
    features = [f for f in S.FEATURES if f in with_features(readings).columns]
    site_aware = site_aware and "source_id" in readings.columns
    complete = with_features(readings).dropna(subset=features).select(*readings.columns)

    # One pass over the table gives the site profiles and, summed, its number of rows.
    by_site = reports.site_profiles(complete) if "source_id" in complete.columns else reports.site_profiles(
        complete.withColumn("source_id", F.lit(S.UNKNOWN_SITE))
    )
    profiles = materialize(by_site, "profiles")
    rows = profiles.agg(F.sum("records")).first()[0] or 0

    params = {
        "features": features,
        "normalization": normalization,
        "legacy_order": legacy_order,
        "site_aware": site_aware,
        "n_trees": n_trees,
        "psi": min(max_samples, rows),
        "seed": seed,
        "rows": rows,
        "trained_date": datetime.now(timezone.utc).isoformat(),
    }
    if legacy_order:
        measures = [m for m in S.MEASURES if m in complete.columns]
        scaler = fit_scaler(complete, measures, normalization)
        feature_scaler = fit_scaler(with_features(apply_scaler(complete, scaler, measures)), features, "global")
    else:
        scaler = fit_scaler(with_features(complete), features, normalization)
        feature_scaler = None

    inputs = [f + _INPUT for f in features]
    prepared = _scaled_inputs(complete, params, scaler, feature_scaler)
    nodes = fit_forest(
        prepared, inputs, key, rows, n_trees, max_samples, seed, source="source_id" if site_aware else None
    )
    return AnomalyModel(nodes, scaler, profiles, params, feature_scaler)


def calibrate(model: AnomalyModel, readings: DataFrame, contamination: float) -> AnomalyModel:
    """Set the thresholds from the scores of ``readings``, which are computed once."""
    return _calibrated(model, readings, contamination)[0]


def _calibrated(model: AnomalyModel, readings: DataFrame, contamination: float) -> tuple[AnomalyModel, DataFrame]:
    """The calibrated model and the stored scores of ``readings``."""
    scores = materialize(model.score(readings).select("score"), "scores")
    cuts = percentile_row(scores, "score", {"threshold": contamination, "severity_cut": S.SEVERITY_PERCENTILE})
    return replace(model, params={**model.params, "contamination": float(contamination), **cuts.first().asDict()}), scores


def _scaled_inputs(
    readings: DataFrame, params: dict, scaler: DataFrame, feature_scaler: DataFrame | None
) -> DataFrame:
    """The readings plus one scaled input column per feature."""
    features = params["features"]
    own = readings.columns
    if not params["legacy_order"]:
        return apply_scaler(with_features(readings), scaler, features, _INPUT).select(
            *own, *[f + _INPUT for f in features]
        )
    measures = [m for m in S.MEASURES if m in own]
    kept = readings.withColumns({f"_raw_{m}": F.col(m) for m in measures})
    scaled = with_features(apply_scaler(kept, scaler, measures))
    scaled = apply_scaler(scaled, feature_scaler, features, _INPUT)
    restored = [F.col(f"_raw_{c}").alias(c) if c in measures else F.col(c) for c in own]
    return scaled.select(*restored, *[f + _INPUT for f in features])
