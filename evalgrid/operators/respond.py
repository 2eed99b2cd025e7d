"""Asking a responder every question of a table."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.constants import NO_RESPONSE_PER_MILLE, RESPONDER_SEED
from evalgrid.functions.numbers import drawn

Responder = Callable[[str, list[str]], str | None]


def respond(trials: DataFrame, responder: Responder) -> DataFrame:
    """``Key, resp`` of a user function called with each question and its accepted answers.

    The function may return None or "" for no response; any other value has to be an
    accepted answer. It is called in Python workers, batch by batch.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for question, accepted in zip(batch["text"], batch["expectedresp"], strict=True):
                accepted = list(accepted)
                given = responder(question, accepted)
                if given and given not in accepted:
                    raise ValueError(f"{given!r} is not one of {accepted}")
                answers.append(given)
            yield pd.DataFrame({"Key": batch["Key"], "resp": pd.Series(answers, dtype=object)})

    return trials.select("Key", "text", "expectedresp").mapInPandas(answer, "Key long, resp string")


def random_responses(trials: DataFrame, seed: int = RESPONDER_SEED) -> DataFrame:
    """``Key, resp`` of a responder that picks any accepted answer, and at times none.

    The draw is a hash of the key, so a lost and repeated task gives the same answers.
    """
    silent = drawn("Key", seed, F.lit("silent")) % 1000
    choice = (drawn("Key", seed, F.lit("choice")) % F.array_size("expectedresp")).cast("int")
    answer = F.when(silent < NO_RESPONSE_PER_MILLE, F.lit("")).otherwise(
        F.try_element_at("expectedresp", choice + 1)
    )
    return trials.select("Key", answer.alias("resp"))
