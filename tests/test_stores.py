import pytest
from pyspark.sql import functions as F

from sunledger.sinks.stores import Store
from sunledger.storage import Versions


def rows(spark, low, high):
    return spark.range(low, high, 1, 1).select(F.col("id").alias("ts"), (F.col("id") * 2).alias("x"))


def content(store):
    return sorted((r.ts, r.x, r.run) for r in store.read().collect())


def test_two_hundred_runs_compacted_under_a_reader(spark, tmp_path):
    path = tmp_path / "store"
    # All runs in one job; a finished run has its own mark.
    spark.range(2000).select(F.col("id").alias("ts"), F.format_string("%03d", F.col("id") % 200).alias("run")).repartition(1).write.partitionBy("run").parquet(str(path))
    for folder in path.glob("run=*"):
        (folder / "_SUCCESS").touch()
    (path / "run=unfinished" / "_temporary").mkdir(parents=True)
    store = Store(spark, str(path))
    before = store.read()
    assert sorted({r.run for r in before.collect()}) == [f"{i:03d}" for i in range(200)]
    store.compact()
    after = store.read()
    assert before.exceptAll(after.select(before.columns)).count() == 0 and after.count() == before.count() == 2000
    assert len(after.inputFiles()) < 10
    store.compact()  # now the runs go; who began before the first compaction has ended
    assert [p.name for p in path.glob("run=*")] == ["run=unfinished"]
    assert after.count() == 2000  # the first snapshot is still there
    store.compact()
    assert store.read().count() == 2000 and len(list((path / "_snapshots").iterdir())) == 2


def test_a_repeated_run_replaces_its_rows_in_a_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read() is None
    store.compact()
    for run_id, low in (("a", 0), ("07", 10)):
        store.write(rows(spark, low, low + 3), run_id)
    store.compact()
    store.write(rows(spark, 50, 52), "a")
    want = sorted([(50, 100, "a"), (51, 102, "a"), *((i, 2 * i, "07") for i in (10, 11, 12))])
    assert content(store) == want
    store.compact()
    assert content(store) == want
    store.compact()
    store.write(rows(spark, 60, 61), "a")  # its folder was deleted by now
    assert content(store) == sorted([(60, 120, "a"), *((i, 2 * i, "07") for i in (10, 11, 12))])
    with pytest.raises(ValueError):
        store.write(rows(spark, 0, 1), "a/b")


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(rows(spark, 0, 500), "a")
    store.write(rows(spark, 500, 1000), "b")
    store.compact(keep=600, order=["ts"])
    assert [r[0] for r in content(store)] == list(range(400, 1000))


def test_of_two_compactions_at_once_one_fails_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.write(rows(spark, 0, 5), "a")
    published = Versions.publish

    def late(self, number, record):
        monkeypatch.setattr(Versions, "publish", published)
        other.compact()  # the other one is first
        published(self, number, record)

    monkeypatch.setattr(Versions, "publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        store.compact()
    assert content(store) == [(i, 2 * i, "a") for i in range(5)]


def test_an_unfinished_record_is_passed_over(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() is None
    versions.publish(1, {"a": "ñ"})
    (tmp_path / "v" / "000000002.json").write_text('{"a": ')
    assert versions.latest() == (1, {"a": "ñ"}) and versions.numbers() == [2, 1]
