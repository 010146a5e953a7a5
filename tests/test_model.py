from dataclasses import replace

import pytest
from helpers import random_sites
from pyspark.sql import functions as F

from sunledger import schema as S
from sunledger.operators import scaling
from sunledger.plans import jobs, tuning
from sunledger.plans.model import AnomalyModel, train
from sunledger.sinks import tables
from sunledger.storage import Versions
from sunledger.streaming.folder import monitor_folder, readings_stream

KEY = ["source_id", "reading_date"]


@pytest.fixture(scope="module")
def readings(spark):
    return random_sites(spark, sites=6, days=80).cache()


@pytest.fixture(scope="module")
def model(readings):
    return train(readings, n_trees=25)


def test_share_of_anomalies_and_severity(readings, model):
    scored = model.get_anomalies(readings)
    n = readings.count()
    assert abs(scored.where("is_anomaly").count() / n - 0.1) < 0.01
    assert scored.where("is_anomaly and severity != 'Alta'").count() == 0
    assert abs(scored.where("severity = 'Alta'").count() / n - 0.1) < 0.01
    again = model.get_anomalies(readings, severity_from="training")
    assert scored.select(*KEY, "severity").exceptAll(again.select(*KEY, "severity")).count() == 0


def test_stored_model_scores_the_same(spark, readings, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = AnomalyModel.load(spark, str(tmp_path / "m"))
    assert loaded.params == model.params
    a, b = (m.predict(readings).select(*KEY, "score", "is_anomaly") for m in (model, loaded))
    assert a.exceptAll(b).count() == 0
    meta = spark.read.json(f"{AnomalyModel.folder(spark, str(tmp_path / 'm'))}/metadata").first()
    assert meta.num_features == 13 + model.profiles.count() and meta.features[:2] == ["Generación total", "Consumo total"] and meta.features[-1] == "EsFinSemana"
    with pytest.raises(FileNotFoundError):
        AnomalyModel.load(spark, str(tmp_path / "none"))


def test_unknown_site_and_missing_value(readings, model):
    odd = readings.limit(2).withColumn("source_id", F.lit("never seen"))
    odd = odd.unionAll(readings.limit(1).withColumn("generation_wh", F.lit(None).cast("double")))
    rows = model.predict(odd).collect()
    assert sum(r.score is None for r in rows) == 1
    assert all(not r.is_anomaly for r in rows if r.score is None)


@pytest.mark.parametrize("options", [{"normalization": "per_company"}, {"normalization": "robust"}, {"legacy_order": True}, {"legacy_order": True, "normalization": "per_company"}])
def test_other_scalings(readings, options):
    scored = train(readings, n_trees=10, **options).predict(readings)
    assert scored.where("score is null").count() == 0
    assert scored.select(readings.columns).exceptAll(readings).count() == 0


def test_constant_column_and_unknown_source_in_scaler(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 9.0, 5.0)], "source_id string, x double, k double")
    scaled = scaling.apply_scaler(df, scaling.fit_scaler(df, ["x", "k"]), ["x", "k"])
    assert {r.k for r in scaled.collect()} == {0.0}
    per_site = scaling.fit_scaler(df.where("source_id = 'a'"), ["x"], "per_company")
    got = {(r.source_id, r.x) for r in scaling.apply_scaler(df, per_site, ["x"]).collect()}
    assert got == {("a", -1.0), ("a", 1.0), ("b", 9.0)}
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["x"], "other")


def test_tuning(readings, spark, tmp_path):
    grid = tuning.grid_search(readings, contaminations=[0.05, 0.2], tree_counts=[5, 20])
    rows = {(r.contamination, r.n_estimators): r for r in grid.collect()}
    assert len(rows) == 4
    assert rows[(0.05, 5)].mean_score == rows[(0.2, 5)].mean_score
    assert rows[(0.05, 20)].num_anomalies <= rows[(0.2, 20)].num_anomalies
    best = tuning.best_parameters(grid).first()
    assert best.contamination == 0.05
    fitted, metrics = tuning.train_with_validation(readings)
    assert fitted.params["rows"] == int(480 * 0.8) and metrics.first().total_samples == 480 - int(480 * 0.8)
    store = str(tmp_path / "store")
    tables.append(readings.where("site_id != 'S0'"), store)
    again = tuning.retrain(store, readings.where("site_id = 'S0'"), fitted)
    assert again.params["rows"] == 480 and spark.read.parquet(store).count() == 480


def test_a_model_is_saved_onto_its_own_path_as_a_new_version(spark, readings, model, tmp_path, monkeypatch):
    path = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        AnomalyModel.load(spark, path)
    assert model.save(path) == 1
    loaded = AnomalyModel.load(spark, path)
    changed = replace(loaded, params={**loaded.params, "threshold": -0.9})
    with monkeypatch.context() as broken:
        broken.setattr(Versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            changed.save(path)
    assert AnomalyModel.load(spark, path).params == loaded.params  # the half-written version does not count
    assert changed.save(path) == 2
    assert AnomalyModel.load(spark, path).params["threshold"] == -0.9
    old = AnomalyModel.load(spark, path, version=1)
    assert old.params == loaded.params
    first = loaded.score(readings).select("source_id", "reading_date", "score")
    assert first.exceptAll(old.score(readings).select(first.columns)).count() == 0
    with pytest.raises(FileNotFoundError):
        AnomalyModel.load(spark, path, version=7)


def test_validate_against_known(readings, model):
    known = model.predict(readings).where("is_anomaly")
    row = tuning.validate(model, readings, known).first()
    assert (row.precision, row.recall, row.f1_score) == (1.0, 1.0, 1.0)


def test_file_jobs_and_folder_monitor(spark, readings, tmp_path):
    inbox = tmp_path / "inbox"
    tables.write_units_csv(readings, str(inbox))
    trained = jobs.train_from_files(spark, [f"{inbox}/*/*.csv"], save_to=str(tmp_path / "model"))
    assert trained.params["rows"] == trained.profiles.agg(F.sum("records")).first()[0]
    assert jobs.train_from_files(spark, ["/no/such.csv"]) is None
    scored, summary, worst = jobs.score_files(spark, trained, f"{inbox}/*/*.csv", str(tmp_path / "scored"), "UNO")
    assert summary.first().total == 480 and worst.count() == min(10, summary.first().anomalies)
    assert "Score_Anomalia" in spark.read.option("header", True).csv(str(tmp_path / "scored")).columns

    seen = []
    where = [str(tmp_path / p) for p in ("alerts", "critical", "check")]
    for _ in range(2):  # the second run finds no new file
        files = readings_stream(spark, str(inbox))
        monitor_folder(files, trained, *where, on_alerts=lambda df: seen.append(df.count()), once=True).awaitTermination()
    expected = jobs.alert_files(spark, trained, f"{inbox}/*/*.csv", str(tmp_path / "a2"), str(tmp_path / "c2"), "one", output=str(tmp_path / "scored2"))
    jobs.alert_files(spark, trained, f"{inbox}/*/*.csv", str(tmp_path / "a2"), str(tmp_path / "c2"), "two", site="DOS")
    both = spark.read.parquet(str(tmp_path / "a2"))
    assert both.where("run = 'one'").count() == expected.count()
    assert [r.empresa for r in both.where("run = 'two'").select("empresa").distinct().collect()] == ["DOS"]
    assert spark.read.option("header", True).csv(str(tmp_path / "scored2")).count() == 480
    stored = spark.read.parquet(where[0])
    assert sum(seen) == stored.count() == expected.count() > 0
    critical = spark.read.parquet(where[1]).drop("run")
    assert critical.count() == stored.where(F.col("severidad") == S.CRITICAL).count()


def test_reports_on_scored_readings(readings, model):
    scored = model.get_anomalies(readings).cache()
    tables_ = jobs.fleet_report(scored)
    assert tables_["summary"].first().total == 480
    assert tables_["score_histogram"].agg(F.sum("rows")).first()[0] == 480
    alerts, summary = jobs.problem_report(model, readings)
    assert summary.first().total == 480 and alerts.count() > 0
    comparison = {r.method: r for r in tuning.compare_normalizations(readings).collect()}
    assert set(comparison) == set(S.NORMALIZATIONS)
    # Scaling all rows alike does not move a split, so the two agree.
    assert comparison["global"].anomalies == comparison["robust"].anomalies


def test_comparison_scores_the_readings_once_for_each_normalisation(readings, monkeypatch):
    """It equals training and then predicting, with one scoring for each model."""
    method = "per_company"
    apart = train(readings, normalization=method).predict(readings).where("is_anomaly").count()
    passes = []
    score = AnomalyModel.score
    monkeypatch.setattr(AnomalyModel, "score", lambda self, *a, **k: passes.append(1) or score(self, *a, **k))
    (row,) = tuning.compare_normalizations(readings, methods=[method]).collect()
    assert (row.anomalies, len(passes)) == (apart, 1)
    assert row.percentage == pytest.approx(100 * apart / readings.count())
