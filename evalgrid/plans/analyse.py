"""The standard report: accuracy overall and per problem, and bias per problem."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid import constants as K
from evalgrid.operators.assemble import assemble_trials_and_results_df
from evalgrid.operators.grouping import base_stats, roll_up, stats_of
from evalgrid.operators.pivot import pivot_pretty
from evalgrid.operators.scoring import compute_acc_table
from evalgrid.session import materialise
from evalgrid.sources.results import load_results_as_dataframe, results_files
from evalgrid.sources.trials import load_trials_as_dataframe


class Report(NamedTuple):
    """Three display tables; ``overall`` is None when there is a single problem."""

    overall: DataFrame | None
    accuracy: DataFrame
    bias: DataFrame


PER_PROBLEM = ("prompting", "modelname", "problemname")
FINEST = (*PER_PROBLEM, "problemsize")

# The report needs no field but the known ones, so the trials are read without a look
# ahead; the tuple's identifier may be of any type on file and is read as text.
_KNOWN_FIELDS = T.StructType([T.StructField("tuple_ID", T.StringType())])


def _finest_keys(results: DataFrame) -> tuple[str, ...]:
    """What there is of ``FINEST``: trials need not have sizes."""
    return tuple(c for c in FINEST if c in results.columns)


def finest_stats(results: DataFrame) -> DataFrame:
    """Accuracy and bias moments per prompting, model, problem and, where trials have it, size.

    All three tables of the report follow from these few rows, so the responses are
    read, joined and reduced once.
    """
    keys = _finest_keys(results)
    return base_stats(compute_acc_table(results, carry=keys), keys, ("acc", "bias"))


def kept_finest_stats(results: DataFrame) -> DataFrame:
    """``finest_stats`` computed now and kept as a table, of the size of the label combinations."""
    return materialise(finest_stats(results), "finest_stats")


def report_stats(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overall accuracy, accuracy per problem and bias per problem from ``finest_stats``."""
    keys = _finest_keys(base)
    accuracy, bias = stats_of(base, keys, "acc"), stats_of(base, keys, "bias")
    # problem sizes are averaged out before problems
    order = [k for k in ("prompting", "modelname", "problemsize", "problemname") if k in keys]
    return (
        roll_up(accuracy, order, ("prompting", "modelname")),
        roll_up(accuracy, keys, PER_PROBLEM),
        roll_up(bias, keys, PER_PROBLEM),
    )


def _heads(base: DataFrame, column: str) -> list[tuple]:
    """The labels that head a table's columns, of which there may not be more than a pivot takes."""
    most = int(base.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    return [tuple(r) for r in base.select(column).distinct().limit(most + 1).collect()]


def analyse_results_df(results: DataFrame) -> Report:
    """The report on assembled trials and responses. Computes the finest statistics now."""
    base = kept_finest_stats(results)
    overall, accuracy, bias = report_stats(base)
    # knowing the few labels saves each table a look at the statistics
    promptings, problems = _heads(base, "prompting"), _heads(base, "problemname")
    down, across = ("prompting", "modelname"), "problemname"
    whole = pivot_pretty(overall, "prompting", ["modelname"], heads=promptings)
    return Report(
        overall=whole if len(problems) > 1 else None,
        accuracy=pivot_pretty(accuracy, across, down, heads=problems),
        bias=pivot_pretty(bias, across, down, scale=1.0, heads=problems),
    )


def analyse_results_in_testset_dir(spark: SparkSession, testset_dir: str) -> Report:
    """The report on every results file of a test set folder."""
    folder = testset_dir.rstrip("/")
    trials = load_trials_as_dataframe(
        spark, f"{folder}/{K.TESTSET_FILE}", include_expname_fields=False, extra=_KNOWN_FIELDS
    )
    # a field that no trial has is not one to group by; the first trial that has it ends the look
    sized = trials.where(F.col("problemsize").isNotNull()).limit(1).count() > 0
    # of the accepted answers only the number goes into the join
    slim = trials.select(
        "Key", "tuple_ID", "goldresp", "problemname", *(["problemsize"] if sized else []),
        F.array_size("expectedresp").alias("expectedresp_len"),
    )
    # one path for a model and prompting, of which Spark's scan keeps a list too
    results = load_results_as_dataframe(spark, results_files(spark, f"{folder}/results"))
    return analyse_results_df(assemble_trials_and_results_df(slim, results))
