"""Means, pooled variances and confidence intervals per group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid import constants as K
from evalgrid.functions.numbers import conf95, ratio, root, total, without_noise


def base_stats(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Count, mean and sample variance of several fields in one aggregate.

    Columns are ``<field>_count`` and so on. Rows with a NULL key are in no group.
    """
    by = list(by)
    figures = []
    for f in fields:
        x = F.col(f).cast("double")
        figures += [
            F.count(x).cast("double").alias(f"{f}_count"),
            F.avg(x).alias(f"{f}_mean"),
            F.var_samp(x).alias(f"{f}_var"),
        ]
    return df.dropna(subset=by).groupBy(*by).agg(*figures)


def stats_of(base: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """The statistics of one field out of ``base_stats``."""
    count, var = F.col(f"{field}_count"), F.col(f"{field}_var")
    std = root(var)
    return base.select(
        *by,
        F.col(f"{field}_mean").alias("mean"),
        ratio(std, F.sqrt(count)).alias("sem"),
        count.alias("count"),
        var.alias("var"),
        std.alias("std"),
    )


def group_stats(df: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """``mean, sem, count, var, std`` of a field per group, missing values left out."""
    return stats_of(base_stats(df, by, [field]), by, field)


def regroup(by: Sequence[str], stats: DataFrame, rebalance: bool = True) -> DataFrame:
    """Merge the statistics of finer groups into those of the groups ``by``.

    The variance is that of the underlying values, not of the finer means. With
    ``rebalance`` all finer groups of a group weigh the same: each counts as often
    as the smallest of them, which is a plain minimum in the same aggregate.
    """
    by = list(by)
    square = F.col("var") + F.col("mean") * F.col("mean")
    if rebalance:
        smallest = F.min("count").cast("double")
        figures = [
            (smallest * F.count(F.lit(1))).alias("count"),
            (smallest * total(F.col("mean"))).alias("sum"),
            (smallest * total(square)).alias("sum_sq"),
        ]
    else:
        figures = [
            F.sum("count").cast("double").alias("count"),
            total(F.col("mean") * F.col("count")).alias("sum"),
            total(square * F.col("count")).alias("sum_sq"),
        ]
    mean, mean_sq = ratio(F.col("sum"), F.col("count")), ratio(F.col("sum_sq"), F.col("count"))
    return (
        stats.dropna(subset=by)
        .groupBy(*by)
        .agg(*figures)
        .withColumns({"mean": mean, "mean_sq": mean_sq})
        .withColumn("var", without_noise(F.col("mean_sq") - F.col("mean") * F.col("mean")))
        .withColumn("std", root(F.col("var")))
        .withColumn("sem", ratio(F.col("std"), F.sqrt("count")))
    )


def finest_keys(columns: Sequence[str], by: Sequence[str]) -> list[str]:
    """``by`` and the fields that will be averaged out with equal weight."""
    return [*by, *(f for f in K.REBALANCED_FIELDS if f in columns and f not in by)]


def roll_up(stats: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Average out, in their fixed order, the fields of ``keys`` that are not in ``by``."""
    level = list(keys)
    for field in [f for f in keys if f not in by]:
        level.remove(field)
        stats = regroup(level, stats)
    return stats.withColumn("conf95", conf95(F.col("sem")))


def accuracy_by_group(
    df: DataFrame,
    by: Sequence[str] = K.DEFAULT_BY,
    rebalance: bool = True,
    accfield: str = "acc",
) -> DataFrame:
    """Statistics of the accuracy per group.

    With ``rebalance`` the problem sizes weigh the same inside a problem and the
    problems weigh the same overall, as far as ``by`` does not separate them.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = finest_keys(df.columns, by) if rebalance else by
    return roll_up(group_stats(df, keys, accfield), keys, by)


def bias_by_group(
    df: DataFrame, by: Sequence[str] = K.DEFAULT_BY, rebalance: bool = True
) -> DataFrame:
    """Statistics of the bias per group, weighted like ``accuracy_by_group``."""
    return accuracy_by_group(df, by, rebalance, "bias")
