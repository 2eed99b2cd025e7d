import json
import random
import re

import pytest

import evalgrid as eg
from evalgrid.operators.assemble import text_digest
from evalgrid.sources import results as result_files
from tests.test_splits import put


def _exchanged(df, capsys):
    """Columns that cross an exchange, by name."""
    df.explain("formatted")
    plan = capsys.readouterr().out
    names = set()
    for columns in re.findall(r"\n\(\d+\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan):
        names |= {c.split("#")[0].strip() for c in columns.split(",")}
    assert "Exchange" in plan
    return names


def _experiment(folder, n, models=("m", "k"), wrong=()):
    put(folder, "e/trials.jsonl", "".join(json.dumps({"Key": 7 * i, "text": f"Question {i}?", "goldresp": "TRUE", "tuple_ID": i}) + "\n" for i in range(n)))
    paths = []
    for m in models:
        rows = [{"row_i": i, "text2": f"Question {i}{'!' if (m, i) in wrong else '?'}", "resp": m} for i in range(n)]
        paths.append(put(folder, f"e/results/{m}__allresults.jsonl", "".join(json.dumps(r) + "\n" for r in rows)))
    return paths


def test_no_text_crosses_an_exchange(spark, folder, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _no_text_crosses(spark, folder, capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _no_text_crosses(spark, folder, capsys):
    df = eg.load_experiment_results_as_dataframe(spark, _experiment(folder, 30))
    names = _exchanged(df.select("Key", "resp", "modelname"), capsys)
    assert not names & {"text", "text2"} and {"__text", "__text2"} <= names
    assert sorted((r.modelname, r.Key, r.text) for r in df.collect()) == sorted(
        (m, 7 * i, f"Question {i}?") for m in ("m", "k") for i in range(30)
    )


def test_a_differing_question_fails_whatever_is_asked_for(spark, folder):
    df = eg.load_experiment_results_as_dataframe(spark, _experiment(folder, 5, wrong={("k", 3)}))
    with pytest.raises(Exception, match="do not line up at row 3"):
        df.select("resp").collect()


def _sides(spark, trials, results):
    return (
        spark.createDataFrame(trials, "EXP_i long, text string, skin string"),
        spark.createDataFrame(results, "EXP_i long, text2 string, modelname string"),
    )


def test_mismatches_equal_those_of_the_full_join(spark):
    rng = random.Random(2)
    trials = [(i, rng.choice([f"t{i}", None, ""]), "x") for i in range(60)]
    results = [(rng.choice([i, i + 5, None]), rng.choice([f"t{i}", None, ""]), m) for i in range(70) for m in "ab"]
    left, right = _sides(spark, trials, results)
    expected = eg.text_mismatches(eg.join_by_position(left, right)).select("EXP_i", "text", "text2")
    found = eg.mismatches_by_position(left, right)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and expected.count() > 40


def test_texts_are_fetched_for_mismatches_alone(spark, capsys):
    left, right = _sides(spark, [(i, f"t{i}", "x") for i in range(50)], [(i, f"t{i}" if i % 9 else "no", "m") for i in range(50)])
    found = eg.mismatches_by_position(left, right)
    assert {r.EXP_i for r in found.collect()} == {i for i in range(50) if i % 9 == 0}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_models", [1, 3, 64, 65, 130])
def test_pending_of_all_models(spark, n_models):
    rng = random.Random(n_models)
    models = [(f"m{i}", None if i % 5 == 0 else "basic") for i in range(n_models)]
    trials = [(k, f"Question {k}") for k in [*range(12), -(2**63), None]]
    results = [(rng.randrange(14), *rng.choice(models), "x") for _ in range(6 * n_models)] * 2 + [(None, *models[0], "x")]
    asked = spark.createDataFrame(trials, "Key long, text string")
    answered = spark.createDataFrame(results, "Key long, modelname string, prompting string, resp string")
    done = {(m, p, k) for k, m, p, _ in results if k is not None}
    expected = sorted(str((m, p, k, t)) for m, p in models for k, t in trials if (m, p, k) not in done)
    found = eg.pending_by_model(asked, answered, models)
    assert sorted(str((r.modelname, r.prompting, r.Key, r.text)) for r in found.collect()) == expected
    seen = {(m, p) for _, m, p, _ in results}
    of_results = eg.pending_by_model(asked, answered)
    assert {(r.modelname, r.prompting) for r in of_results.collect()} == seen


def test_pending_without_models_or_responses(spark):
    asked = spark.createDataFrame([(1, "x")], "Key long, text string")
    none = spark.createDataFrame([], "Key long, modelname string, prompting string")
    assert eg.pending_by_model(asked, none).count() == 0
    assert eg.pending_by_model(asked, none, [("m", "p")]).count() == 1


def test_a_text_is_sent_as_it_is_if_it_is_shorter_than_its_digest(spark):
    texts = [None, "", "Q1.1", "x" * 15, "x" * 16, "é" * 7, "é" * 8, "x" * 200]
    sent = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_digest("t")).collect()]
    plain = [None if t is None else t.encode() for t in texts]
    assert [None if s is None else bytes(s) for s in sent[:4]] == plain[:4] and bytes(sent[5]) == plain[5]
    assert [len(sent[i]) for i in (4, 6, 7)] == [16] * 3 and len({bytes(s) for s in sent[1:]}) == 7


def test_paths_of_experiments_cross_no_exchange(spark, folder, monkeypatch):
    for name in ("one", "a b%20+é"):
        put(folder, f"{name}/trials.jsonl", "".join(json.dumps({"Key": k, "text": f"{name}{k}", "goldresp": "TRUE"}) + "\n" for k in range(4)))
        put(folder, f"{name}/results/t+y %__allresults.jsonl/part-00000-x.json", "".join(json.dumps({"row_i": i, "text2": f"{name}{i}", "resp": "TRUE"}) + "\n" for i in range(4)))
    joined, kinds = result_files.answered_by_position, []
    monkeypatch.setattr(result_files, "answered_by_position", lambda *a: kinds.extend(dict(x.dtypes)["__folder"] for x in a[:2]) or joined(*a))
    rows = eg.load_all_results(spark, [folder]).collect()
    assert sorted((r.EXPNAME, r.EXP_i, r.text) for r in rows) == sorted((n, i, f"{n}{i}") for n in ("one", "a b%20+é") for i in range(4))
    assert {r.modelname for r in rows} == {"t+y %"}
    assert kinds == ["binary", "binary"]


def test_what_a_path_tells_is_worked_out_once_for_a_file(spark, folder):
    for tail in ({}, {"cut_tail": True}, {"skip_corrupt": True}):
        rows = eg.load_experiment_results_as_dataframe(spark, _experiment(folder, 5), **tail)
        assert sorted((r.modelname, r.Key) for r in rows.collect()) == sorted((m, 7 * i) for m in ("m", "k") for i in range(5))
        # the list of files, which has a row for each
        assert "Relation [path" in rows._jdf.queryExecution().optimizedPlan().toString()
