"""Reading and writing the file layouts."""

import bz2
import gzip
import json
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import evalgrid as eg
from evalgrid import schemas, session
from evalgrid.functions import labels
from evalgrid.sources import trials as trial_files
from evalgrid.sources.records import read_json
from evalgrid.sources.results import results_files

NO_EXTRA = T.StructType([])


def trial(key, gold="Emmanuel", **more):
    return {
        "Key": key, "text": f"Question {key}, \"quoted\" é?", "expectedresp": ["TRUE", "FALSE"],
        "goldresp_obfusc": gold, "problemname": "Infer.normal", "problemsize": 3,
        "skin": "old/young", "tuple_ID": key // 2, "complexity": "Complexity_1", "query_len": 3,
        **more,
    }


TRIALS = [trial(k, "Emmanuel" if k % 2 else "Megi", extra=k * 1.5) for k in range(-3, 9)]


def lines(records):
    return "".join(json.dumps(r) + "\n" for r in records)


def as_columns(records):
    return json.dumps({f: {str(i): r[f] for i, r in enumerate(records)} for f in records[0]})


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raw = data.encode()
    if name.endswith(".bz2"):
        raw = bz2.compress(raw)
    elif name.endswith(".gz"):
        raw = gzip.compress(raw)
    elif name.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("member", data)
        return path
    with open(path, "wb") as f:
        f.write(raw)
    return path


ALL_NAMES = [kind + packed for kind in (".jsonl", ".json") for packed in ("", ".gz", ".bz2", ".zip")]


@pytest.mark.parametrize("ending", ALL_NAMES)
@pytest.mark.parametrize("given", [False, True])
def test_every_layout_gives_the_same_trials(spark, folder, ending, given):
    text = lines(TRIALS) if "jsonl" in ending else json.dumps(TRIALS)
    path = put(folder, "exp/trials" + ending, text)
    extra = T.StructType([T.StructField("extra", T.DoubleType())]) if given else None
    df = eg.load_trials_as_dataframe(spark, path, extra=extra)
    rows = df.orderBy("EXP_i").collect()
    assert [r.Key for r in rows] == [t["Key"] for t in TRIALS]
    assert [r.EXP_i for r in rows] == list(range(len(TRIALS)))
    assert {r.EXPNAME for r in rows} == {"exp"}
    assert [r.goldresp for r in rows] == ["TRUE" if t["Key"] % 2 else "FALSE" for t in TRIALS]
    assert [r.extra for r in rows] == [t["extra"] for t in TRIALS]
    assert [r.text for r in rows] == [t["text"] for t in TRIALS]
    assert rows[0].expectedresp == ["TRUE", "FALSE"]
    assert not [c for c in df.columns if c.startswith("__")]


@pytest.mark.parametrize("ending", [".json", ".json.gz", ".json.zip"])
def test_document_of_columns(spark, folder, ending):
    path = put(folder, "exp/trials" + ending, as_columns(TRIALS))
    df = eg.load_trials_as_dataframe(spark, path, extra=NO_EXTRA, auto_deobfuscate=False)
    rows = df.orderBy("EXP_i").collect()
    assert [r.Key for r in rows] == [t["Key"] for t in TRIALS]
    assert [r.EXP_i for r in rows] == list(range(len(TRIALS)))
    assert rows[0].expectedresp == ["TRUE", "FALSE"] and rows[0].text == TRIALS[0]["text"]


def test_document_of_columns_without_schema_is_refused(spark, folder):
    path = put(folder, "x.json", as_columns(TRIALS))
    with pytest.raises(ValueError, match="schema"):
        eg.read_json(spark, path)


def test_other_endings_are_refused(spark, folder):
    with pytest.raises(ValueError, match="end in"):
        eg.read_json(spark, put(folder, "x.csv", "a"))
    with pytest.raises(ValueError, match="jsonl"):
        eg.load_results_as_dataframe(spark, put(folder, "basic___m___results.json", "[]"))
    with pytest.raises(FileNotFoundError):
        eg.load_trials_as_dataframe(spark, folder + "/trials.jsonl")
    with pytest.raises(FileNotFoundError):
        eg.load_testset(spark, folder + "/nowhere")
    with pytest.raises(FileNotFoundError):
        eg.load_trainset(spark, folder + "/nowhere.bz2")


def test_row_numbers_across_splits_and_parts(spark, folder):
    """Many small splits of a bzip2 file and of a folder of parts."""
    n = 20_000
    text = "".join(json.dumps(trial(k)) + "\n" for k in range(n))
    plain = put(folder, "one/trials.jsonl", text)
    packed = put(folder, "two/trials.jsonl.bz2", text)
    for i, start in enumerate(range(0, n, 4000)):
        part = "".join(json.dumps(trial(k)) + "\n" for k in range(start, start + 4000))
        put(folder, f"three/trials.jsonl/part-{i:05d}-x.json", part)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(300_000))
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for path in (plain, packed, folder + "/three/trials.jsonl"):
            df = eg.load_trials_as_dataframe(spark, path, extra=NO_EXTRA)
            assert df.where("EXP_i <> Key").count() == 0 and df.count() == n
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parts_are_ordered_by_number(spark, folder):
    for number, key in ((99999, 0), (100000, 1)):
        put(folder, f"e/trials.jsonl/part-{number}-x.json", lines([trial(key)]))
    df = eg.load_trials_as_dataframe(spark, folder + "/e/trials.jsonl", extra=NO_EXTRA)
    assert {(r.Key, r.EXP_i) for r in df.collect()} == {(0, 0), (1, 1)}


def test_readable_gold_is_kept(spark, folder):
    records = [trial(1), {**trial(2), "goldresp": "FALSE"}]
    del records[1]["goldresp_obfusc"]
    path = put(folder, "e/trials.jsonl", lines(records))
    for extra in (None, NO_EXTRA):
        df = eg.load_trials_as_dataframe(spark, path, extra=extra)
        assert [r.goldresp for r in df.orderBy("Key").collect()] == ["TRUE", "FALSE"]


def test_params_fields(spark, folder):
    params = {"a": 1, "b": "x", "c": [1, 2.5], "d": None, "e": True}
    spec = {"experimentname": "e", "summary": "s", "seed": 3}
    for name, value in (("e", [params]), ("f", params)):
        put(folder, f"{name}/trials.jsonl", lines(TRIALS))
        put(folder, f"{name}/{name}.json", json.dumps({**spec, "params": value}))
        df = eg.load_trials_as_dataframe(spark, f"{folder}/{name}/trials.jsonl", include_params_fields=True)
        row = df.first()
        assert {k: row[f"PARAM_{k}"] for k in params} == {k: repr(v) for k, v in params.items()}
    assert eg.load_experiment_specs(spark, f"{folder}/e/e.json") == ("e", "s", 3, [params])
    with pytest.raises(ValueError):
        eg.load_experiment_specs(spark, f"{folder}/e/nothing.json")


def test_obfuscation_is_undone(spark):
    golds = ["TRUE", "FALSE", "POSSIBLE", "IMPOSSIBLE", "1", "2", "3", "other", None]
    df = spark.createDataFrame([(g,) for g in golds], "goldresp string")
    hidden = eg.obfuscate_goldresp(df)
    assert hidden.columns == ["goldresp_obfusc"]
    assert [r[0] for r in hidden.collect()][6:] == ["Yoda", "other", None]
    assert [r[0] for r in eg.deobfuscate_goldresp(hidden).collect()] == golds
    with pytest.raises(ValueError):
        eg.deobfuscate_goldresp(df)
    with pytest.raises(ValueError):
        eg.obfuscate_goldresp(hidden)


def test_results_keep_text_and_labels(spark, folder):
    put(folder, "results/basic___Llama2-FT+1M___results.jsonl", lines([{"Key": -9223372036854775808, "resp": "1"}]))
    put(folder, "results/in a b%c___m__x___results.jsonl", lines([{"Key": 2, "resp": 3}, {"Key": 3, "resp": None}]))
    paths = results_files(spark, folder)
    df = eg.load_results_as_dataframe(spark, [p for p in paths])
    assert df.dtypes[:2] == [("Key", "bigint"), ("resp", "string")]
    assert {tuple(r) for r in df.collect()} == {
        (-9223372036854775808, "1", "Llama2-FT+1M", "basic"),
        (2, "3", "m__x", "in a b%c"), (3, None, "m__x", "in a b%c"),
    }
    bare = eg.load_results_as_dataframe(spark, paths, add_modelname_and_prompting=False)
    assert bare.columns == ["Key", "resp"]


def test_results_written_are_read_back(spark, folder):
    answers = spark.createDataFrame([(1, "TRUE"), (2, ""), (3, None)], "Key long, resp string")
    path = eg.write_results(answers, folder + "/results", "basic", "m+1")
    assert path.endswith("/results/basic___m+1___results.jsonl")
    with pytest.raises(PySparkException):
        eg.write_results(answers, folder + "/results", "basic", "m+1")
    eg.write_results(answers.where("Key = 1").withColumn("Key", F.lit(4).cast("long")), folder + "/results", "basic", "m+1", mode="append")
    expected = {(1, "TRUE"), (2, ""), (3, ""), (4, "TRUE")}
    for paths in (path, folder + "/results/*___results.jsonl", results_files(spark, folder)):
        df = eg.load_results_as_dataframe(spark, paths)
        assert {(r.Key, r.resp) for r in df.collect()} == expected
        assert {(r.modelname, r.prompting) for r in df.collect()} == {("m+1", "basic")}
    with pytest.raises(ValueError):
        eg.write_results(answers, folder, "a___b", "m")


def test_cut_off_record(spark, folder):
    text = lines([{"Key": k, "resp": "TRUE"} for k in range(5)]) + '{"Key": 5, "re'
    path = put(folder, "basic___m___results.jsonl", text)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        eg.load_results_as_dataframe(spark, path).collect()
    df = eg.load_results_as_dataframe(spark, path, skip_corrupt=True)
    assert sorted(r.Key for r in df.collect()) == [0, 1, 2, 3, 4]
    assert df.count() == 5
    assert df.select("modelname").count() == 5


@pytest.mark.parametrize(
    "name, expected",
    [
        ("basic___GPT4___results.jsonl", ("GPT4", "basic")),
        ("/a/b/basic___Llama2-FT+1M___results.jsonl", ("Llama2-FT+1M", "basic")),
        ("x/toy__allresults.pkls", ("toy", None)),
        ("toy__v2__allresults.pkls.partial", ("toy", None)),
        ("toy__allresults.jsonl", ("toy", None)),
        ("basic___results.jsonl", None),
        ("a___b___c___results.jsonl", None),
        ("other.jsonl", None),
        ("toy__allresults", None),
    ],
)
def test_labels_of_a_name(spark, name, expected):
    df = spark.createDataFrame([("file:/r/" + name,)], "path string")
    column = labels.with_labels(df, "path").select("modelname", "prompting")
    if expected is None:
        with pytest.raises(ValueError):
            eg.infer_modelname_and_prompting(name)
        with pytest.raises(PySparkException):
            column.collect()
    else:
        assert eg.infer_modelname_and_prompting(name) == expected
        assert tuple(column.first()) == expected


def test_experiment_folders(spark, folder):
    put(folder, "a/trials.jsonl.bz2", lines(TRIALS[:4]))
    put(folder, "b/trials.jsonl", lines(TRIALS[:3]))
    put(folder, "b/trials.json", json.dumps(TRIALS[:2]))
    put(folder, "c/other.txt", "")
    assert eg.get_trials_file(spark, folder + "/b").endswith("trials.json")
    assert eg.is_experiment_directory(spark, folder + "/a")
    results = put(folder, "a/results/basic___m___results.jsonl", "")
    for path in (folder + "/a", folder + "/a/trials.jsonl.bz2", results):
        assert eg.infer_expname_and_expdir(spark, path) == ("a", folder + "/a")
    for path in (folder + "/c", folder + "/nothing", put(folder, "c/results/basic___m___results.jsonl", "")):
        with pytest.raises(FileNotFoundError):
            eg.infer_expname_and_expdir(spark, path)
    assert not eg.is_experiment_directory(spark, folder + "/c")
    both = eg.load_all_trials(spark, [folder + "/a", folder + "/b"])
    assert {(r.EXPNAME, r.EXP_i) for r in both.collect()} == {
        *(("a", i) for i in range(4)), *(("b", i) for i in range(2))
    }
    with pytest.raises(FileNotFoundError):
        eg.load_all_trials(spark, [folder + "/c"])
    with pytest.raises(ValueError):
        eg.load_all_trials(spark, [])
    assert eg.load_as_dataframe(spark, folder + "/a").count() == 4
    assert eg.load_as_dataframe(spark, folder + "/b/trials.jsonl", include_expname_fields=False).count() == 3
    with pytest.raises(ValueError):
        eg.load_as_dataframe(spark, folder + "/c/other.txt")
    with pytest.raises(FileNotFoundError):
        eg.load_as_dataframe(spark, folder + "/nowhere")


def test_files_found_below_a_folder(spark, folder):
    put(folder, "r/x/basic___m___results.jsonl", "{}\n")
    put(folder, "r/basic___n___results.jsonl/part-00000.json", "{}\n")
    put(folder, "r/basic___n___results.jsonl/part-00001.json", "{}\n")
    put(folder, "r/notes.txt", "")
    found = eg.find_files_ending_in(spark, folder, "___results.jsonl")
    assert {(os.path.basename(r.path), r.bytes) for r in found.collect()} == {
        ("basic___m___results.jsonl", 3), ("basic___n___results.jsonl", 6)
    }


def test_trainset(spark, folder):
    record = {"dialog_history": {"messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": "b"}]}, "target_message": "TRUE"}
    path = put(folder, "trials_10k.bz2", lines([record]))
    rows = eg.flatten_dialogs(eg.load_trainset(spark, path)).collect()
    assert [tuple(r) for r in rows] == [(0, "user", "a", "TRUE"), (1, "bot", "b", "TRUE")]
    assert eg.load_trainset(spark, path).schema == schemas.DIALOGS


def test_analysis_of_a_folder_with_text_tuple_identifiers(spark, folder):
    records = [{**trial(k, "Emmanuel" if k % 2 else "Megi"), "tuple_ID": f"t{k // 2}"} for k in range(40)]
    put(folder, "test/trials.jsonl.bz2", lines(records))
    right = [{"Key": k, "resp": "TRUE" if k % 2 else "FALSE"} for k in range(40)]
    wrong = [{"Key": k, "resp": "TRUE"} for k in range(39)]
    put(folder, "test/results/basic___good___results.jsonl", lines(right))
    put(folder, "test/results/deep/er/basic___yes___results.jsonl", lines(wrong))
    report = eg.analyse_results_in_testset_dir(spark, folder + "/test")
    assert report.overall is None
    assert [tuple(r) for r in report.accuracy.collect()] == [
        ("basic", "good", "100.0 (0.0)"), ("basic", "yes", "50.0 (0.0)")
    ]
    assert [tuple(r) for r in report.bias.collect()] == [
        ("basic", "good", "0.00 (0.00)"), ("basic", "yes", "1.00 (0.00)")
    ]
    assembled = eg.load_and_assemble_trials_and_results(
        spark, folder + "/test/trials.jsonl.bz2", results_files(spark, folder + "/test")
    )
    assert assembled.count() == 79 and "EXP_i" in assembled.columns
    with pytest.raises(ValueError):
        eg.load_results_as_dataframe(spark, [])


def test_spec_text():
    spec = {"experimentname": "e", "summary": "s", "seed": 1, "params": {"x": 1}}
    assert trial_files.parse_experiment_specs(json.dumps(spec))[3] == {"x": 1}


SLIM = T.StructType([T.StructField("Key", T.LongType()), T.StructField("goldresp", T.StringType())])


def _keys(df):
    return sorted(r.Key for r in df.collect())


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_lists_and_columns_are_told_apart_by_document(spark, folder, order):
    columns = put(folder, "a.json", json.dumps({"Key": {"0": 1, "1": 2}, "goldresp": {"0": "x", "1": "y"}}))
    records = put(folder, "l.json", json.dumps([{"Key": 3, "goldresp": "z"}, {"Key": 4, "goldresp": "z"}]))
    paths = [(columns, records)[i] for i in order]
    assert _keys(read_json(spark, paths, SLIM)) == [1, 2, 3, 4]


@pytest.mark.parametrize("broken", ['{"Key": {"0": 1', '[{"Key": 3}, {"Ke', "3", '{"Key": {"0": "no number"}}'])
@pytest.mark.parametrize("first", [True, False])
def test_a_broken_document_fails_or_is_left_out(spark, folder, broken, first):
    good = put(folder, "g.json", json.dumps({"Key": {"0": 1, "1": 2}}))
    bad = put(folder, "b.json", broken)
    paths = [bad, good] if first else [good, bad]
    with pytest.raises(Exception, match="MALFORMED_RECORD|neither a list|CAST_INVALID_INPUT"):
        read_json(spark, paths, SLIM).collect()
    found = {r.Key for r in read_json(spark, paths, SLIM, skip_corrupt=True).collect()}
    assert {1, 2} <= found and found <= {1, 2, 3, None}


def test_archives_may_hold_both_forms(spark, folder):
    path = f"{folder}/x.json.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("a.json", json.dumps({"Key": {"0": 1}}))
        archive.writestr("b.json", json.dumps([{"Key": 2}]))
    assert _keys(read_json(spark, path, SLIM)) == [1, 2]


@pytest.mark.parametrize("n", [1, 100, 101])
def test_names_are_checked_for_any_number_of_files(spark, folder, n):
    paths = [put(folder, f"r/p___m{i}___results.jsonl", lines([{"Key": i, "resp": "TRUE"}])) for i in range(n)]
    assert eg.load_results_as_dataframe(spark, paths).count() == n
    assert eg.load_results_as_dataframe(spark, f"{folder}/r/*.jsonl").select("modelname").distinct().count() == n
    bad = put(folder, "r/bad.jsonl", lines([{"Key": 1, "resp": "TRUE"}]))
    for wanted in ([*paths, bad], f"{folder}/r/*.jsonl"):
        with pytest.raises(ValueError):
            eg.load_results_as_dataframe(spark, wanted).count()


def test_a_filter_on_a_label_skips_files(spark, folder):
    for i in range(5):
        put(folder, f"r/p___m{i}___results.jsonl", lines([{"Key": k, "resp": "x"} for k in range(10)]))
    df = eg.load_results_as_dataframe(spark, f"{folder}/r/*.jsonl").where("modelname = 'm3'")
    assert df.count() == 10 and {r.prompting for r in df.collect()} == {"p"}


def test_corrupt_records_are_counted(spark, folder):
    put(folder, "r/p___m___results.jsonl", lines([{"Key": 1, "resp": "x"}]) + '{"Key": 2, "re\n{"Key": 3}\n')
    found = eg.corrupt_records(spark, f"{folder}/r/*.jsonl", schemas.RESULTS).collect()
    assert [(r.n_records, r.n_corrupt) for r in found] == [(3, 1)]


def test_cut_off_positional_records_fail_unless_skipped(spark, folder):
    put(folder, "e/trials.jsonl", lines([trial(k) for k in range(3)]))
    whole = [{"row_i": k, "text2": trial(k)["text"], "resp": "TRUE"} for k in range(2)]
    path = put(folder, "e/results/m__allresults.jsonl", lines(whole) + '{"row_i": 2, "tex')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        eg.load_experiment_results_as_dataframe(spark, path).collect()
    assert eg.load_experiment_results_as_dataframe(spark, path, skip_corrupt=True).count() == 2


def test_a_temporary_folder_only_serves_one_process(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return self.named

    class Session:
        sparkContext = Context()
        conf = {}

    session.shared_folder(spark)
    Session.sparkContext.named = None
    with pytest.raises(ValueError):
        session.shared_folder(Session)
    Session.sparkContext.named = "hdfs://x/checkpoints/"
    assert session.shared_folder(Session) == "hdfs://x/checkpoints"
