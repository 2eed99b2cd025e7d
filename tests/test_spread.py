"""Files that queries write are dealt out to tasks by the number of rows."""

import glob

import pytest
from pyspark.sql import functions as F

from evalgrid.plans import catalog
from evalgrid.plans import derived as D


@pytest.fixture
def sf_dir(spark, folder):
    keys = F.when(F.col("id") % 100 == 0, 7).otherwise(F.col("id"))  # some keys repeat
    spark.range(3000).select(keys.alias("o_orderkey")).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_orders_are_dealt_out_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(D, "n_tasks", lambda *_: 5)
    spread = D.spread_orders(spark, sf_dir)
    assert spread.rdd.getNumPartitions() == 5
    assert D.trials(spark, sf_dir, spread).exceptAll(D.trials(spark, sf_dir)).count() == 0
    assert D.trials(spark, sf_dir).exceptAll(D.trials(spark, sf_dir, spread)).count() == 0


def test_number_of_tasks_follows_the_orders(spark, sf_dir):
    assert [D.n_tasks(spark, sf_dir, n) for n in (1000, 1001, 2999, 3000, 9999)] == [3, 3, 2, 1, 1]


def test_trials_in_order_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(D, "n_tasks", lambda *_: 4)
    path = catalog._stored_trials(spark, sf_dir, "jsonl", "none", sort=True)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))
    keys = [r.Key for f in files for r in spark.read.json(f).select("Key").collect()]
    assert len(files) == 4 and keys == sorted(keys)


def test_documents_are_not_one_for_a_few_rows(spark, sf_dir):
    found = glob.glob(catalog._documents(spark, sf_dir, ".json", "none").removeprefix("file:"))
    assert len(found) == 1


def test_growing_results_are_in_files_of_bounded_length(spark, sf_dir, folder, monkeypatch):
    whole = [tuple(r) for r in catalog.growing_results(spark, sf_dir).orderBy("modelname").collect()]
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{folder}/{name}")
    monkeypatch.setattr(catalog, "_GROWING_ORDERS", 1000)
    again = [tuple(r) for r in catalog.growing_results(spark, sf_dir).orderBy("modelname").collect()]
    assert len(glob.glob(f"{folder}/growing/results/*/*")) == 9
    assert again == whole and all(r[1] > 0 for r in whole)


def test_trials_follow_the_order_of_the_orders(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(D, "n_tasks", lambda *_: 4)
    ordered = D.trials(spark, sf_dir, D.ordered_orders(spark, sf_dir)).sortWithinPartitions("Key")
    parts = [[r.Key for r in part] for part in ordered.rdd.glom().collect()]
    assert len(parts) == 4 and sum(map(bool, parts)) > 1
    assert [k for part in parts for k in part] == sorted(k for part in parts for k in part)
    assert ordered.exceptAll(D.trials(spark, sf_dir)).count() == D.trials(spark, sf_dir).exceptAll(ordered).count() == 0


def test_responses_by_position_are_packed_in_files_of_bounded_length(spark, sf_dir, folder, monkeypatch):
    whole = sorted(map(tuple, catalog.responses_by_position(spark, sf_dir).collect()))
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{folder}/{name}")
    monkeypatch.setattr(catalog, "_PACKED_ROWS", 500)
    monkeypatch.setattr(D, "n_tasks", lambda *_: 3)
    assert sorted(map(tuple, catalog.responses_by_position(spark, sf_dir).collect())) == whole
    files = glob.glob(f"{folder}/experiments/*/trials.jsonl/part-*") + glob.glob(f"{folder}/experiments/*/results/*/part-*")
    assert len(files) > 6 + 30 and all(f.endswith(".json.gz") for f in files)
    assert max(spark.read.text(f).count() for f in files if "/results/" in f) <= 500


@pytest.mark.parametrize("way", ["packed", "not reached", "empty"])
def test_trials_are_packed_as_spark_packs_them(spark, sf_dir, folder, monkeypatch, way):
    monkeypatch.setattr(D, "n_tasks", lambda *_: 3)
    expected = sorted(r.value for r in spark.read.text(catalog._stored_trials(spark, sf_dir, "jsonl.bz2", "bzip2")).collect())
    if way == "not reached":
        monkeypatch.setattr(catalog.pieces, "reaches", lambda path: False)
    if way == "empty":
        spark.read.parquet(f"{sf_dir}/orders.parquet").limit(0).write.parquet(f"{folder}/none/orders.parquet")
        sf_dir, expected = f"{folder}/none", []
    path = catalog._packed_trials(spark, sf_dir)
    assert sorted(r.value for r in spark.read.text(path).collect()) == expected and path.endswith("/trials.jsonl.bz2")
    files = [f.rpartition("/")[2] for f in glob.glob(f"{path.removeprefix('file:')}/*") if "_SUCCESS" not in f]
    assert all(f.startswith("part-") and f.endswith(".json.bz2") for f in files)
    if way == "packed":
        assert sorted(files) == [f"part-0000{i}.json.bz2" for i in range(3)]
