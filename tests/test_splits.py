import bz2
import json
import os

import pytest
from pyspark.sql import types as T

import evalgrid as eg
from evalgrid import schemas
from evalgrid.sources import splits
from evalgrid.sources.records import damage_by_place, inferred_schema, lines_but_cut_tail, with_row_index

TEXT = "a question of some length, so that few records fill a split " * 3


def put(folder, name, text):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def trials(n, first=0):
    return "".join(json.dumps({"Key": first + i, "text": TEXT, "tuple_ID": i // 2, "extra": i / 2}) + "\n" for i in range(n))


def results(n, first=0):
    return "".join(json.dumps({"Key": first + i, "resp": "TRUE " * 20}) + "\n" for i in range(n))


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def _numbers(df):
    return {r.Key: r.EXP_i for r in df.collect()}


@pytest.fixture
def looks(monkeypatch):
    """How often files are looked at for their splits."""
    seen, found = [], splits._found
    monkeypatch.setattr(splits, "_found", lambda *a: seen.append(a) or found(*a))
    return seen


def test_the_directory_is_made_once_and_anew_for_changed_files(spark, folder, looks, small_splits):
    path = put(folder, "e/trials.jsonl", trials(300))
    assert _numbers(eg.load_trials_as_dataframe(spark, path)) == {i: i for i in range(300)}
    assert len(looks) == 1
    again = eg.load_trials_as_dataframe(spark, path)
    assert _numbers(again) == {i: i for i in range(300)} and len(looks) == 1
    assert dict(again.dtypes)["extra"] == "double"
    put(folder, "e/trials.jsonl", trials(310))
    assert _numbers(eg.load_trials_as_dataframe(spark, path)) == {i: i for i in range(310)}
    assert len(looks) == 2


def test_bzip2_is_read_twice_at_first_and_once_afterwards(spark, folder, looks):
    put(folder, "t/trials.jsonl.bz2", bz2.compress(trials(5000).encode()))
    for _ in range(2):
        assert _numbers(eg.load_testset(spark, f"{folder}/t")) == {i: i for i in range(5000)}
    assert len(looks) == 1
    plan = eg.load_testset(spark, f"{folder}/t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "FileScan text" not in plan


def test_another_way_to_split_is_noticed(spark, folder, looks, small_splits):
    path = put(folder, "e/trials.jsonl", trials(300))
    planned = eg.load_trials_as_dataframe(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    with pytest.raises(Exception, match="split in another way"):
        planned.collect()
    assert _numbers(eg.load_trials_as_dataframe(spark, path)) == {i: i for i in range(300)}
    assert len(looks) == 2


def test_parts_are_numbered_through(spark, folder, small_splits):
    for part, first in ((0, 0), (2, 100), (100000, 150)):
        put(folder, f"e/trials.jsonl/part-{part:05d}-x.json", trials(100 if part == 0 else 50, first))
    put(folder, "f/trials.jsonl", "\n \n" + trials(70, 1000) + "\r\n\n")
    df = with_row_index(spark, [f"{folder}/e/trials.jsonl", f"{folder}/f/trials.jsonl"], schemas.TRIALS)
    assert _numbers(df) == {i: i for i in range(200)} | {1000 + i: i for i in range(70)}


@pytest.mark.parametrize("records", [
    [{"a": 1, "b": "x", "c.d": None, "e f": True}, {"a": 2, "g": [1, 2.5]}],
    [{"a": 1}, {"a": 2.0}, {"a": None}], [{"a": 2.0}, {"a": [2.0]}], [{"a": 1}, {"a": "x"}], [{"a": 2**64}, {"a": 1}],
    [{"a": 2**64}, {"a": 0.5}], [{"a": 1e300}, {"a": 1}], [{"a": {}}, {"b": []}], [{"a": {"x": {}, "y": [None]}}],
    [{"a": {"p": 1}}, {"a": {"q q": "s", "p": 0.5}}], [{"a": [{"p": 1}]}, {"a": [{"p": "t"}]}], [{}], [{"a": [{}]}],
    [{"a": True}, {"a": 1}], [{"a": 123456789012345678}, {"a": 1234567890123456789}],
])
def test_types_are_those_of_the_json_source(spark, folder, records):
    path = put(folder, "x.jsonl", "".join(json.dumps(r) + "\n" for r in records))
    assert inferred_schema(spark, path) == spark.read.json(path).schema


def test_types_of_several_splits_are_merged(spark, folder, small_splits):
    path = put(folder, "x.jsonl", trials(100) + json.dumps({"extra": "now text", "more": 0.5}) + "\n" + trials(100))
    assert inferred_schema(spark, path) == spark.read.json(path).schema


def test_malformed_records_fail_the_look_ahead(spark, folder):
    path = put(folder, "e/trials.jsonl", trials(3) + '{"Key": 4, "te')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        eg.load_trials_as_dataframe(spark, path)


# --- damage by place ---------------------------------------------------------

CUT = '{"Key": 999, "re'


def _keys(df):
    return sorted(r.Key for r in df.collect())


def _load(spark, folder, **options):
    return eg.load_results_as_dataframe(spark, f"{folder}/r/*___results.jsonl", **options)


@pytest.mark.parametrize("end", ["", "\n", "\n\n \n"])
def test_a_cut_tail_is_forgiven(spark, folder, small_splits, end):
    put(folder, "r/p___a+ b%20___results.jsonl", results(200) + CUT + end)
    put(folder, "r/p___b___results.jsonl", results(3, 500))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        _load(spark, folder).collect()
    df = _load(spark, folder, cut_tail=True)
    assert _keys(df) == [*range(200), 500, 501, 502]
    assert {r.modelname for r in df.select("modelname").distinct().collect()} == {"a+ b%20", "b"}
    assert df.count() == 203 and df.select("prompting").count() == 203


@pytest.mark.parametrize("at", [0, 57, 199])
def test_damage_before_the_end_fails(spark, folder, small_splits, at):
    put(folder, "r/p___m___results.jsonl", results(at) + CUT + "\n" + results(200 - at, at))
    with pytest.raises(Exception, match=f"damaged record before the end.*row {at}"):
        _load(spark, folder, cut_tail=True).collect()
    assert _keys(_load(spark, folder, skip_corrupt=True)) == list(range(200))


def test_a_wrong_type_is_damage_whatever_is_asked_for(spark, folder):
    put(folder, "r/p___m___results.jsonl", results(2) + '{"Key": "x", "resp": "TRUE"}\n' + results(1, 2))
    with pytest.raises(Exception, match="damaged record"):
        _load(spark, folder, cut_tail=True).select("resp").collect()


def test_a_record_longer_than_a_split_is_the_last_one(spark, folder, small_splits):
    put(folder, "r/p___m___results.jsonl", results(50) + '{"Key": 999, "resp": "' + "x" * 20_000)
    assert _keys(_load(spark, folder, cut_tail=True)) == list(range(50))


def test_only_the_last_part_of_a_folder_ends_the_file(spark, folder):
    name = "r/p___m___results.jsonl/part-0000{}-x.json"
    put(folder, name.format(0), results(5))
    put(folder, name.format(1), results(5, 5) + CUT)
    assert _keys(_load(spark, folder, cut_tail=True)) == list(range(10))
    put(folder, name.format(2), results(5, 10))
    with pytest.raises(Exception, match="damaged record before the end"):
        _load(spark, folder, cut_tail=True).collect()


def test_damage_is_counted_by_place(spark, folder, small_splits):
    put(folder, "r/p___a___results.jsonl", results(100) + CUT + "\n" + results(100, 100) + CUT)
    put(folder, "r/p___b___results.jsonl", results(100) + CUT + "\n" + CUT + "\n" + results(1, 100))
    put(folder, "r/p___c___results.jsonl", CUT)
    found = damage_by_place(spark, f"{folder}/r/*.jsonl", schemas.RESULTS).collect()
    assert sorted((r.path[-17:-16], r.n_records, r.n_damaged, r.n_cut_off) for r in found) == [
        ("a", 202, 1, 1), ("b", 103, 2, 0), ("c", 1, 0, 1)
    ]


def test_both_tolerances_exclude_each_other(spark, folder):
    put(folder, "r/p___a___results.jsonl", results(1))
    with pytest.raises(ValueError):
        _load(spark, folder, cut_tail=True, skip_corrupt=True)


def test_positional_responses_forgive_a_cut_tail_only(spark, folder):
    put(folder, "e/trials.jsonl", trials(4))
    line = [json.dumps({"row_i": i, "text2": TEXT, "resp": "TRUE"}) + "\n" for i in range(3)]
    path = put(folder, "e/results/m__allresults.jsonl", "".join(line) + '{"row_i": 3, "te')
    assert eg.load_experiment_results_as_dataframe(spark, path, cut_tail=True).count() == 3
    path = put(folder, "e/results/m__allresults.jsonl", line[0] + '{"row_i": 1, "te\n' + line[2])
    with pytest.raises(Exception, match="damaged record"):
        eg.load_experiment_results_as_dataframe(spark, path, cut_tail=True).collect()


def test_an_empty_file_has_no_records(spark, folder):
    put(folder, "r/p___a___results.jsonl", "\n")
    assert _load(spark, folder, cut_tail=True).count() == 0
    assert lines_but_cut_tail(spark, f"{folder}/r/p___a___results.jsonl", schemas.RESULTS).count() == 0


def test_a_directory_with_fields_serves_a_load_that_knows_them(spark, folder, looks):
    path = put(folder, "e/trials.jsonl", trials(50))
    inferred = eg.load_trials_as_dataframe(spark, path)
    known = eg.load_trials_as_dataframe(spark, path, extra=T.StructType([]))
    assert _numbers(inferred) == _numbers(known) == {i: i for i in range(50)}
    assert len(looks) == 1
    assert splits.split_directory(spark, [path]).columns == ["__split_file", "__block", "__first", "n", "whole", "before", "is_last"]
    put(folder, "e/trials.jsonl", trials(60))
    for extra in (T.StructType([]), None, T.StructType([])):
        assert _numbers(eg.load_trials_as_dataframe(spark, path, extra=extra)) == {i: i for i in range(60)}
    assert len(looks) == 3
