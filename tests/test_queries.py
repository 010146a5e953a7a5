import glob
import os

import compare
import pytest

from sunledger.queries import ORACLES, QUERIES, ingest, prediction
from sunledger.storage import checkpoint_dir

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_equals_its_sql(spark, database, key):
    got = QUERIES[key](spark, SF_DIR).toPandas()
    assert compare.compare(got, database.execute(ORACLES[key]).df()) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_large_site_has_several_json_arrays(spark, database, monkeypatch, tmp_path):
    monkeypatch.setattr(ingest, "ARRAY_RECORDS", 100)
    monkeypatch.setattr(ingest, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = QUERIES["S06_json_history"](spark, SF_DIR).toPandas()
    assert compare.compare(got, database.execute(ORACLES["S06_json_history"]).df()) is None
    assert len(glob.glob(f"{tmp_path}/s06/arrays/n=*")) > got.site_id.nunique()


def test_parts_of_the_trend_stream_keep_their_partitions(spark, database, monkeypatch, tmp_path):
    whole = prediction.V.stressed
    monkeypatch.setattr(prediction.V, "stressed", lambda spark, sf: whole(spark, sf).repartition(4))
    monkeypatch.setattr(prediction, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = QUERIES["T04_stream_trends"](spark, SF_DIR).toPandas()
    assert compare.compare(got, database.execute(ORACLES["T04_stream_trends"]).df()) is None
    assert len(glob.glob(f"{tmp_path}/t04/in/*.parquet")) > 3


def test_history_arrays_follow_records_not_sites(spark):
    found = QUERIES["S06_json_history"](spark, SF_DIR)
    assert len(found.inputFiles()) == -(-found.count() // 10_000)


@pytest.mark.parametrize("name", ["A10_precision_recall", "J03_true_positives", "J05_false_negatives"])
def test_predicted_and_known_come_from_one_stored_table(spark, name):
    files = QUERIES[name](spark, SF_DIR).inputFiles()
    assert files and not any("lineitem" in f for f in files)


STORED = {
    "T05_problems_on_arrival": {"t05p", "t05p-in"},
    "M15_problem_files": {"m15", "m15-a", "m15-b", "m15-c"},
    "T04_stream_trends": {"t04"},
}


@pytest.mark.parametrize("key", STORED)
def test_readings_are_stored_as_input_and_as_results_only(spark, key):
    """No step in between stores the readings once more; tables of a few keys may be stored."""
    folder = f"{checkpoint_dir(spark)}/sunledger"
    before = set(glob.glob(f"{folder}/*"))
    rows = QUERIES[key](spark, SF_DIR).count()
    assert rows > 1000
    for path in set(glob.glob(f"{folder}/*")) - before:
        name = os.path.basename(path).rsplit("-", 1)[0]
        if name not in STORED[key]:
            assert spark.read.parquet(path).count() < rows / 10, name
