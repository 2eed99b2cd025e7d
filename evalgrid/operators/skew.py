"""Giving every row a figure of its whole group without gathering the group.

A window over the group would send all rows of a group to one task. Here the
figures come from an aggregate, which combines on the map side, and travel back to
the rows by a join. A group that fills a partition of that join is split among
tasks by Spark's adaptive skew join, whatever its rows hold, equal ones included:
only the one row of figures is repeated. No other column takes part in either
exchange than the caller goes on to use.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.lookups import named


def with_group_totals(df: DataFrame, by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add to each row the aggregates ``totals`` of its group.

    Rows with a NULL key belong to no group and get NULL.
    """
    by = list(by)
    groups = df.dropna(subset=by).groupBy(*by).agg(*(a.alias(n) for n, a in totals.items()))
    kept = df.drop(*totals)
    return kept.join(groups, by, "left").select(*map(named, kept.columns), *map(named, totals))
