"""A model answers a test set in several runs."""

import bz2
import json

import evalgrid as eg
from evalgrid.plans import answer
from tests.test_splits import put


def stored(folder, keys):
    records = [{"Key": k, "text": f"Q{k}", "expectedresp": ["TRUE", "FALSE"], "goldresp": "TRUE"} for k in keys]
    put(folder, "t/trials.jsonl.bz2", bz2.compress("".join(json.dumps(r) + "\n" for r in records).encode()))
    return f"{folder}/t"


def test_a_run_reads_the_trials_once(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(answer, "write_results", lambda df, *_, **__: written.append(df))
    eg.answer_testset(spark, stored(folder, range(1000)), "basic", "m", eg.random_responses)
    (checked,) = written
    assert sorted(r.Key for r in checked.collect()) == list(range(1000))
    # read by one side of the join with itself, and used again by the other
    plan = checked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan json") == 1 and "ReusedExchange" in plan


def test_runs_answer_what_is_left(spark, folder):
    where = stored(folder, [None, 0, 1, 1, 2, 3, 4, 4, 4])
    for reached in (lambda t: t.where("Key % 2 = 0"), None):
        path = eg.answer_testset(spark, where, "basic", "m", eg.random_responses, reached)
    answered = sorted(r.Key for r in eg.load_results_as_dataframe(spark, path).collect())
    # a trial that stands several times has each answer checked against each
    assert answered == [0, *[1] * 4, 2, 3, *[4] * 9]
    path = eg.answer_testset(spark, where, "basic", "asked", lambda t: eg.respond(t, lambda question, accepted: accepted[0]), lambda t: t.where("Key is not null"))
    assert {r.resp for r in eg.load_results_as_dataframe(spark, path).collect()} == {"TRUE"}
