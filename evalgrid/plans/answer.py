"""A model answers a test set, as often as it takes."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalgrid.operators.assemble import merged, pending_trials, require_valid_responses
from evalgrid.sources.records import path_exists
from evalgrid.sources.results import load_results_as_dataframe, results_path, write_results
from evalgrid.sources.trials import load_testset


def answer_testset(
    spark: SparkSession,
    testset_dir: str,
    prompting: str,
    modelname: str,
    answer: Callable[[DataFrame], DataFrame],
    reached: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Answer the trials of a test set folder that the model has no response to, and return its results file.

    ``answer`` makes ``Key, resp`` of trials, such as ``random_responses`` or ``respond`` with a
    function. Responses are checked against the accepted answers and appended to the model's file,
    so a run that broke off is resumed by calling again. ``reached`` narrows the trials of this run.
    """
    folder = testset_dir.rstrip("/") + "/results"
    path = results_path(folder, prompting, modelname)
    trials = load_testset(spark, testset_dir)
    if path_exists(spark, path):
        # a record that an earlier run left cut off is a trial without response
        trials = pending_trials(trials, load_results_as_dataframe(spark, path, skip_corrupt=True))
    trials = trials if reached is None else reached(trials)
    # dealt out by key once, for what answers them and for the check; else the files would be read for each
    trials = trials.repartition("Key")
    checked = require_valid_responses(answer(trials).join(merged(trials.select("Key", "expectedresp")), "Key"))
    return write_results(checked, folder, prompting, modelname, mode="append")
