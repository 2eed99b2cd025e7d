"""Seeded random order and row prefixes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.constants import SHUFFLE_SEED
from evalgrid.functions.numbers import drawn


def shuffle_df(
    df: DataFrame,
    keep_groups: Sequence[str] | str | None = None,
    seed: int = SHUFFLE_SEED,
    key: Sequence[str] | str = "Key",
    place: str | None = None,
) -> DataFrame:
    """Rows in a random order that depends only on ``seed`` and the row's ``key``.

    With ``keep_groups`` the groups are shuffled and the rows of a group stay together,
    in the order of ``key``; rows without a group are left out. The order is a range
    sort, so a large group spans as many partitions as it needs. ``place`` names a column
    for the number that the rows or groups are ordered by.
    """
    key = [key] if isinstance(key, str) else list(key)
    groups = [keep_groups] if isinstance(keep_groups, str) else list(keep_groups or ())
    number = drawn(*(groups or key), seed)
    df = df.dropna(subset=groups) if groups else df
    if place is not None:
        df, number = df.withColumn(place, number), F.col(place)
    return df.orderBy(number, *groups, *key)


def first_rows(df: DataFrame, n: int | Column, row_index: str = "EXP_i") -> DataFrame:
    """The first ``n`` rows by row number; unlike ``limit`` this needs no order.

    ``n`` may be the size of another table, as a scalar subquery.
    """
    return df.where(F.col(row_index) < n)
