"""Joins by key and by position, checks, profiles, comparison, order, responders."""

import random
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import evalgrid as eg
from evalgrid.operators.assemble import text_mismatches
from evalgrid.plans import derived as D

SF = "/root/testdata/sf0.001"


def trials(spark):
    rows = [(k, f"q{k}", ["TRUE", "FALSE"]) for k in range(5)]
    return spark.createDataFrame(rows, "Key long, text string, expectedresp array<string>")


def responses(spark, pairs, model="m"):
    rows = [(k, r, model, "basic") for k, r in pairs]
    return spark.createDataFrame(rows, "Key long, resp string, modelname string, prompting string")


def test_assemble_takes_one_or_many(spark):
    a, b = responses(spark, [(0, "TRUE"), (9, "TRUE")]), responses(spark, [(0, "FALSE")], "n")
    for given in ([a, b], a.union(b)):
        rows = eg.assemble_trials_and_results_df(trials(spark), given).collect()
        assert {(r.Key, r.resp, r.modelname, r.text) for r in rows} == {
            (0, "TRUE", "m", "q0"), (0, "FALSE", "n", "q0")
        }
    with pytest.raises(ValueError):
        eg.assemble_trials_and_results_df(trials(spark), [])


def test_pending_and_coverage(spark):
    done = responses(spark, [(0, "TRUE"), (0, "TRUE"), (3, "")])
    assert sorted(r.Key for r in eg.pending_trials(trials(spark), done).collect()) == [1, 2, 4]
    row = eg.coverage(trials(spark), done).first()
    assert (row.n_results, row.n_trials, row.is_partial) == (3, 5, True)


def test_response_checks(spark):
    rows = responses(spark, [(0, "TRUE"), (1, ""), (2, None), (3, "MAYBE"), (4, "true")])
    df = eg.assemble_trials_and_results_df(trials(spark), rows)
    assert sorted(r.Key for r in eg.invalid_responses(df).collect()) == [3, 4]
    with pytest.raises(PySparkException, match="accepted answer"):
        eg.require_valid_responses(df).select("Key").collect()
    assert eg.require_valid_responses(df.where("Key < 3")).count() == 3
    text = eg.reprompts(df).where("Key = 3").first().text
    assert text == "q3\nOnly respond with one of these options:[TRUE, FALSE]"


def positional(spark, n_trials, n_results, wrong=()):
    left = spark.createDataFrame([(i, f"q{i}") for i in range(n_trials)], "EXP_i long, text string")
    right = spark.createDataFrame(
        [(i, "?" if i in wrong else f"q{i}", "TRUE") for i in range(n_results)],
        "EXP_i long, text2 string, resp string",
    )
    return eg.join_by_position(left, right)


def test_join_by_position(spark):
    joined = positional(spark, 5, 3)
    assert joined.count() == 3 and text_mismatches(joined).count() == 0
    assert eg.require_same_text(joined).columns == ["EXP_i", "resp", "text"]
    assert [r.EXP_i for r in text_mismatches(positional(spark, 5, 4, wrong=[2])).collect()] == [2]
    for bad in (positional(spark, 5, 4, wrong=[2]), positional(spark, 3, 4)):
        with pytest.raises(PySparkException, match="line up"):
            eg.require_same_text(bad).select("resp").collect()


def put(path, records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in records))


def test_responses_by_position_from_files(spark, folder):
    for name in ("one", "two"):
        put(f"{folder}/{name}/trials.jsonl", [
            {"Key": k, "text": f"{name}{k}", "expectedresp": ["TRUE", "FALSE"], "goldresp": "TRUE"} for k in range(4)
        ])
    record = {"fullresp1": "Yes.", "resp": "TRUE", "confidence": 0.5}
    put(f"{folder}/one/results/toy__v2__allresults.jsonl", [{"row_i": i, "text2": f"one{i}", **record} for i in range(4)])
    put(f"{folder}/two/results/toy__allresults.jsonl.partial", [{"row_i": i, "text2": f"two{i}", "resp": ""} for i in range(2)])
    complete = eg.load_all_results(spark, [folder])
    assert complete.count() == 4 and "prompting" not in complete.columns
    row = complete.orderBy("EXP_i").first()
    assert (row.modelname, row.EXPNAME, row.text, row.fullresp1, row.fullresp2, row.clarified) == (
        "toy", "one", "one0", "Yes.", None, 0
    )
    both = eg.load_all_results(spark, [f"{folder}/one", f"{folder}/two"], include_partials=True)
    assert {(r.EXPNAME, r.EXP_i) for r in both.collect()} == {
        *(("one", i) for i in range(4)), *(("two", i) for i in range(2))
    }
    path = f"{folder}/two/results/toy__allresults.jsonl.partial"
    assert eg.load_as_dataframe(spark, path).count() == 2
    bare = eg.load_experiment_results_as_dataframe(
        spark, path, include_expname_fields=False, trials_path=f"{folder}/two/trials.jsonl"
    )
    assert not {"EXPNAME", "EXP_i"} & set(bare.columns) and bare.count() == 2
    put(f"{folder}/two/results/bad__allresults.jsonl", [{"row_i": 0, "text2": "two1", "resp": ""}])
    with pytest.raises(PySparkException, match="line up"):
        eg.load_as_dataframe(spark, f"{folder}/two/results/bad__allresults.jsonl").collect()
    with pytest.raises(ValueError):
        eg.load_all_results(spark, [f"{folder}/two/trials.jsonl"])


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", '{"k": 1}'), (2, None, "[1]"), (3, "c", "2"), (4, "d", "1.5"), (5, "e", "oops"), (6, "f", "null"), (7, "g", "true")],
        "`x.y` int, s string, j string",
    )
    rows = {r.field: r for r in eg.datatype_counts(df, json_fields=["j"]).collect()}
    assert (rows["x.y"]["size"], rows["x.y"]["count"], rows["x.y"].isna, rows["x.y"].int) == (7, 7, 0, 7)
    assert (rows["s"].isna, rows["s"].void, rows["s"].string, rows["s"].int) == (1, 1, 6, None)
    j = rows["j"]
    kinds = ("object", "array", "bigint", "decimal", "string", "void", "boolean")
    assert [j[k] for k in kinds] == [1, 1, 1, 1, 1, 1, 1]


def test_comparison(spark):
    a = spark.createDataFrame([(0, "x", 1, None), (1, "y", 2, None), (2, "z", 3, None)], "i int, s string, n int, e string")
    b = spark.createDataFrame([(0, "x", "1", 1), (1, "?", "2", 1)], "i int, s string, n string, f int")
    rows = {r.field: r for r in eg.compare_dataframes(a, b, "i").collect()}
    assert {f: (r.found_in, r.n_differing, r.same) for f, r in rows.items()} == {
        "i": ("both", 0, True), "s": ("both", 1, False), "n": ("both", 0, False),
        "e": ("only_1", None, None), "f": ("only_2", None, None),
    }
    assert (rows["s"].rows_1, rows["s"].rows_2, rows["s"].n_compared) == (3, 2, 2)
    same = eg.compare_dataframes(a, a, "i").collect()
    assert all(r.same for r in same)
    assert {r.field: r.found_in for r in eg.field_sets(a, b).collect()}["n"] == "both"


def test_shuffle_is_seeded_and_keeps_groups_together(spark):
    df = D.trials(spark, SF).select("Key", "tuple_ID").repartition(3)
    keys = [r.Key for r in eg.shuffle_df(df).collect()]
    again = [r.Key for r in eg.shuffle_df(df.repartition(7)).collect()]
    assert keys == again != sorted(keys) and len(set(keys)) == df.count()
    assert keys != [r.Key for r in eg.shuffle_df(df, seed=1).collect()]
    with_gap = df.withColumn("tuple_ID", F.when(F.col("tuple_ID") > 0, F.col("tuple_ID")))
    rows = eg.shuffle_df(with_gap, "tuple_ID").collect()
    assert len(rows) == df.where("tuple_ID > 0").count()
    changes = sum(a.tuple_ID != b.tuple_ID for a, b in zip(rows, rows[1:]))
    assert changes == len({r.tuple_ID for r in rows}) - 1
    assert [r.tuple_ID for r in rows] != sorted(r.tuple_ID for r in rows)


def test_prefix(spark):
    df = spark.range(10).withColumnRenamed("id", "EXP_i")
    assert sorted(r[0] for r in eg.first_rows(df, 3).collect()) == [0, 1, 2]
    n = spark.range(4).agg(F.count(F.lit(1))).scalar()
    assert eg.first_rows(df, n).count() == 4


def test_responder(spark):
    df = trials(spark)
    answers = {0: "TRUE", 1: "", 2: None, 3: "FALSE", 4: "TRUE"}
    got = eg.respond(df, lambda question, accepted: answers[int(question[1:])])
    assert {r.Key: r.resp for r in got.collect()} == answers
    with pytest.raises(PySparkException, match="not one of"):
        eg.respond(df, lambda question, accepted: "MAYBE").collect()


def test_random_responder_is_at_chance_level(spark):
    df = D.trials(spark, "/root/testdata/sf0.01").cache()
    answers = eg.random_responses(df)
    assert {tuple(r) for r in answers.collect()} == {
        tuple(r) for r in eg.random_responses(df.repartition(5)).collect()
    }
    silent = answers.where("resp = ''").count() / answers.count()
    assert 0.003 < silent < 0.007
    scores = eg.compute_acc_table(
        eg.assemble_trials_and_results_df(df, answers).withColumns(
            {"modelname": F.lit("random"), "prompting": F.lit("basic")}
        )
    )
    for r in eg.accuracy_by_group(scores, ["modelname", "problemname"]).collect():
        assert r["mean"] == pytest.approx(0.5, abs=0.03)
    for r in eg.bias_by_group(scores, ["modelname", "problemname"]).collect():
        expected = 0.33 if r.problemname.startswith("Compl") else 0.0
        assert r["mean"] == pytest.approx(expected, abs=0.05)
    df.unpersist()


def test_new_results_files_are_taken_in_once(spark, folder):
    def ingest():
        query = eg.ingest_new_results(
            spark, trials(spark), folder + "/results/*___results.jsonl", folder + "/table", folder + "/state"
        )
        query.awaitTermination()
        return {(r.Key, r.modelname) for r in spark.read.parquet(folder + "/table").collect()}

    eg.write_results(responses(spark, [(0, "TRUE"), (7, "TRUE")]), folder + "/results", "basic", "a")
    assert ingest() == {(0, "a")}
    eg.write_results(responses(spark, [(1, "TRUE")]), folder + "/results", "basic", "b")
    assert ingest() == ingest() == {(0, "a"), (1, "b")}
    assert spark.read.parquet(folder + "/table").count() == 2


def test_repeated_row_numbers_are_refused(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "i int, x string")
    two = spark.createDataFrame([(1, "a"), (2, "c")], "i int, x string")
    for pair in ((one, two), (two, one)):
        with pytest.raises(ValueError):
            eg.compare_dataframes(*pair, on="i")
    numbered = spark.createDataFrame([(None, "a"), (None, "b"), (2, "c")], "i int, x string")
    found = {r.field: r for r in eg.compare_dataframes(numbered, two, on="i").collect()}
    assert (found["x"].rows_1, found["x"].rows_2, found["x"].n_compared) == (3, 2, 1)


def test_shuffles_are_sorted_by_their_number(spark):
    df = spark.range(200).select(F.col("id").alias("Key"), (F.col("id") % 7).alias("g"))
    for groups in (None, "g"):
        rows = [(r.place, r.g, r.Key) for r in eg.shuffle_df(df, keep_groups=groups, place="place").collect()]
        assert len(rows) == 200 and [r[0] for r in rows] == sorted(r[0] for r in rows)
        if groups:
            assert rows == sorted(rows) and len({r[0] for r in rows}) == 7
        else:
            assert [r[2] for r in rows] != sorted(r[2] for r in rows)


def test_pivot_compares_values_as_what_they_are(spark):
    stats = spark.createDataFrame(
        [("m", True, "a | b", "c", 1.0), ("m", False, "a", "b | c", 2.0), ("m", True, None, "c", 3.0)],
        "modelname string, flag boolean, x string, y string, mean double",
    ).withColumn("sem", F.lit(0.0))
    table = eg.pivot_pretty(stats, ["flag", "x", "y"], ["modelname"], cell_style="mean", scale=1.0)
    row = table.collect()[0].asDict()
    assert sorted(v for k, v in row.items() if k != "modelname") == [1.0, 2.0, 3.0]
    assert "true | null | c" in row and len(row) == 4


def _brute_comparison(a, b, fields):
    left, right = ({r[0]: r for r in rows if r[0] is not None} for rows in (a, b))
    shared = left.keys() & right.keys()
    return len(a), len(b), len(shared), {f: sum(left[k][i] != right[k][i] for k in shared) for i, f in enumerate(fields) if i}


@pytest.mark.parametrize("buckets", [1, 4, 64])
@pytest.mark.parametrize("changed", [0, 1, 40])
def test_comparison_by_checksums_equals_brute_force(spark, buckets, changed):
    rng = random.Random(buckets + changed)
    fields = "i long, x string, y double, z string"
    a = [(i, rng.choice(["p", "q", None]), rng.choice([0.5, None]), f"z{i}") for i in range(300)]
    b = [tuple(r) for r in a]
    for k in rng.sample(range(300), changed):
        b[k] = (k, "other", *b[k][2:]) if k % 2 else (1000 + k, *b[k][1:])
    if changed:
        a += [(None, "n", 1.0, "z")] * 3
        b += [(None, "n", 1.0, "z")]
    found = eg.compare_dataframes(spark.createDataFrame(a, fields), spark.createDataFrame(b, fields), "i", buckets=buckets).collect()
    rows_1, rows_2, n, differing = _brute_comparison(a, b, "ixyz")
    assert {(r.rows_1, r.rows_2, r.n_compared) for r in found} == {(rows_1, rows_2, n)}
    assert {r.field: r.n_differing for r in found} == {"i": 0} | differing
    assert {r.field: r.same for r in found} == {"i": True} | {f: d == 0 for f, d in differing.items()}


def test_equal_tables_are_not_joined(spark):
    a = spark.range(500).select("id", (F.col("id") * 2).alias("x"), F.lit("t").alias("y"))
    plan = eg.compare_dataframes(a, a.repartition(7), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    b = a.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x")))
    plan = eg.compare_dataframes(a, b, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "v0" in plan and "v1" not in plan  # the field that differs, and no other


def test_row_numbers_of_other_types_are_compared_too(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "i long, s string")
    found = {r.field: r for r in eg.compare_dataframes(a, b, "i").collect()}
    assert (found["s"].n_compared, found["s"].n_differing, found["i"].same) == (2, 1, False)
    empty = {r.field: r for r in eg.compare_dataframes(a.limit(0), a, "i").collect()}
    assert (empty["s"].rows_1, empty["s"].rows_2, empty["s"].n_compared, empty["s"].n_differing) == (0, 2, 0, 0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_questions_gather_no_side_on_the_driver(spark):
    # a row of the file becomes many, of which the planner knows nothing
    many = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("Key")).selectExpr("cast(Key as long) AS Key", "'q' || Key AS text")
    answered = many.select("Key", F.lit("TRUE").alias("resp"))
    by_place = many.withColumnRenamed("Key", "EXP_i")
    for joined in (
        eg.assemble_trials_and_results_df(many, answered),
        eg.join_by_position(by_place, by_place.withColumnRenamed("text", "text2")),
    ):
        assert "Broadcast" not in _plan(joined)
        assert joined.count() == 100


def test_pending_trials_hold_no_table_of_keys(spark):
    done = responses(spark, [(0, "TRUE"), (0, "TRUE"), (3, ""), (None, "")])
    pending = eg.pending_trials(trials(spark), done)
    assert "Aggregate" not in _plan(pending) and "Broadcast" not in _plan(pending)
    assert sorted(r.Key for r in pending.collect()) == [1, 2, 4]
