"""Bringing trials and responses together."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions import lookups as L
from evalgrid.session import materialise

# Rows that are sent to every task to fetch the texts of; more are joined by size.
MOST_SENT = 100_000


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is NULL there."""
    frames = list(frames)
    if not frames:
        raise ValueError("there is nothing to put together")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged(rows: DataFrame) -> DataFrame:
    """To be joined by exchange and sort, whatever the planner takes its size for."""
    return rows.hint("merge")


def assemble_trials_and_results_df(
    trials: DataFrame, results: DataFrame | Iterable[DataFrame]
) -> DataFrame:
    """Responses of all models with the trial each one answers.

    One join for all models. No side is broadcast: both have a row for a question or more, and
    the planner takes those that are unnested or unpacked on the way for far fewer than they are,
    so it would gather them on the driver. A key with very many responses is split by the
    adaptive skew join.
    """
    answered = results if isinstance(results, DataFrame) else stack(results)
    return answered.join(merged(trials), "Key", "inner")


def pending_trials(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Trials without a response yet, to resume an interrupted run."""
    # repeated keys do no harm to an anti-join; to drop them first, a task would hold all keys it scans
    return merged(trials).join(merged(results.select("Key")), "Key", "left_anti")


def pending_by_model(
    trials: DataFrame, results: DataFrame, models: Sequence[tuple[str, str | None]] | None = None
) -> DataFrame:
    """Trials without a response yet, for every model: the trials' columns, ``modelname`` and ``prompting``.

    ``models`` are pairs of (modelname, prompting), those of ``results`` if not given, which takes a look
    at their labels. One aggregate over the responses keeps, for each key, a bit for each model, 64 to a
    number; so all models take one scan and one join, and a row is made only for what is pending. A NULL
    key is answered by no response. A model with responses that is not in ``models`` is not asked about.
    """
    spark, labels = trials.sparkSession, ["modelname", "prompting"]
    if models is None:
        models = [tuple(r) for r in results.select(*labels).distinct().collect()]
    models = sorted(set(models), key=str)
    numbered = spark.createDataFrame(
        [(i // 64, i % 64, *m) for i, m in enumerate(models)], "__word int, __bit int, modelname string, prompting string"
    )
    both = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in labels]
    answered = (
        results.alias("r").join(F.broadcast(numbered.alias("m")), both)
        .groupBy("r.Key", "m.__word").agg(F.bit_or(F.expr("shiftleft(1L, m.__bit)")).alias("__done"))
    )
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(F.coalesce("__done", F.lit(0).cast("long")), b) == 0, b))
    words = F.explode(F.sequence(F.lit(0), F.lit((len(models) - 1) // 64))) if models else F.explode(F.array().cast("array<int>"))
    left = trials.withColumn("__word", words).join(answered, ["Key", "__word"], "left")
    left = left.withColumn("__bit", F.explode(F.array_compact(bits)))
    return left.join(F.broadcast(numbered), ["__word", "__bit"]).select(*map(L.named, trials.columns), *labels)


def coverage(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Rows answered per model and prompting, next to the number of trials."""
    n_trials = trials.agg(F.count(F.lit(1)).alias("n_trials")).scalar()
    return (
        results.groupBy("modelname", "prompting")
        .agg(F.count(F.lit(1)).alias("n_results"))
        .withColumn("n_trials", n_trials)
        .withColumn("is_partial", F.col("n_results") != F.col("n_trials"))
    )


def invalid_responses(df: DataFrame) -> DataFrame:
    """Rows whose response is not one of the accepted answers."""
    return df.where(~L.answer_is_valid("resp", "expectedresp"))


def require(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """Pass rows through; a row for which ``holds`` is not true fails the job."""
    return df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def require_valid_responses(df: DataFrame) -> DataFrame:
    """Pass rows through; a response outside the accepted answers fails the job."""
    message = F.concat(
        F.lit("response is not an accepted answer, Key "), F.col("Key").cast("string")
    )
    return require(df, L.answer_is_valid("resp", "expectedresp"), message)


def reprompts(df: DataFrame) -> DataFrame:
    """The question to ask again for each invalid response."""
    return invalid_responses(df).withColumn("text", L.reprompt("text", "expectedresp"))


# --- by position -------------------------------------------------------------


def join_by_position(
    trials: DataFrame, results: DataFrame, on: Iterable[str] = ("EXP_i",)
) -> DataFrame:
    """Join the i-th response to the i-th trial through an explicit row number.

    ``results`` carries the row number under the same name, and its own copy
    ``text2`` of the question. Trials beyond the last response drop out. Responses
    beyond the last trial stay, with no question, for the check to find.
    """
    return results.join(merged(trials), list(on), "left")


def text_mismatches(joined: DataFrame) -> DataFrame:
    """Rows where the question on file and the question answered differ."""
    return joined.where(~F.col("text").eqNullSafe(F.col("text2")))


def require_same_text(joined: DataFrame) -> DataFrame:
    """Pass rows on without ``text2``; a differing question fails the job."""
    message = F.concat(F.lit("trials and results do not line up at row "), F.col("EXP_i").cast("string"))
    return require(joined, F.col("text").eqNullSafe(F.col("text2")), message).drop("text2")


def text_digest(c: Column | str) -> Column:
    """16 bytes that stand for a text, or a shorter one itself; NULL for NULL."""
    text = L.column(c).cast("binary")
    return F.when(F.octet_length(text) < 16, text).otherwise(F.unhex(F.md5(text)))


def answered_by_position(
    trials: DataFrame, results: DataFrame, on: Iterable[str] = ("EXP_i",)
) -> DataFrame:
    """The i-th response with the i-th trial; a differing question fails the job.

    The same rows as ``require_same_text`` of ``join_by_position``, but the questions are compared by
    digests taken before the exchange. ``text2`` crosses none, and ``text`` only if it is asked for.
    """
    asked = trials.withColumn("__text", text_digest("text"))
    answered = results.withColumn("__text2", text_digest("text2")).drop("text2")
    joined = join_by_position(asked, answered, on)
    message = F.concat(F.lit("trials and results do not line up at row "), F.col("EXP_i").cast("string"))
    return require(joined, F.col("__text").eqNullSafe(F.col("__text2")), message).drop("__text", "__text2")


def mismatches_by_position(
    trials: DataFrame, results: DataFrame, on: Iterable[str] = ("EXP_i",)
) -> DataFrame:
    """``on, text, text2`` of the responses whose question differs from the trial's, like ``text_mismatches``.

    Row numbers and digests are joined first; texts are fetched for the rows that differ alone.
    """
    on = list(on)
    answered = results.select(*on, text_digest("text2").alias("__text2"))
    asked = trials.select(*on, text_digest("text").alias("__text"))
    differ = answered.join(asked, on, "left").where(~F.col("__text").eqNullSafe(F.col("__text2")))
    rows = materialise(differ.select(*on).distinct(), "differing")
    rows = (F.broadcast(rows) if rows.count() <= MOST_SENT else rows).alias("d")

    def fetched(side: DataFrame, text: str) -> DataFrame:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in on]
        return side.select(*on, text).alias("s").join(rows, same, "left_semi")

    questions = materialise(fetched(trials, "text"), "questions")
    return text_mismatches(fetched(results, "text2").join(questions, on, "left")).select(*on, "text", "text2")
