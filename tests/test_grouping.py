"""Statistics per group, and merging them."""

import math
import random

import pytest
from pyspark.sql import types as T

from evalgrid import accuracy_by_group, bias_by_group, group_stats, regroup

ROWS = "problemname string, problemsize int, acc double"


def stats(spark, groups, rebalance=True):
    """Statistics over the sizes of one problem; a group is the values of one size."""
    rows = [("p", size, float(v)) for size, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, ROWS)
    return regroup(["problemname"], group_stats(df, ["problemname", "problemsize"], "acc"), rebalance).first()


def test_single_row_has_no_variance(spark):
    df = spark.createDataFrame([("p", 1, 1.0)], ROWS)
    row = group_stats(df, ["problemname"], "acc").first()
    assert (row["mean"], row["count"], row["var"], row["std"], row["sem"]) == (1, 1, None, None, None)


def test_rebalanced(spark):
    row = stats(spark, [[1, 0], [1, 1, 1, 0]])
    assert (row["count"], row["mean"], row["mean_sq"], row["var"], row["std"], row["sem"]) == (
        4, 0.625, 0.78125, 0.390625, 0.625, 0.3125
    )


def test_not_rebalanced(spark):
    row = stats(spark, [[1, 0], [1, 1, 1, 0]], rebalance=False)
    assert row["count"] == 6
    assert row["mean"] == pytest.approx(0.666667, abs=1e-6)
    assert row["var"] == pytest.approx(0.347222, abs=1e-6)
    assert row["sem"] == pytest.approx(0.240563, abs=1e-6)


def test_plain_statistics(spark):
    df = spark.createDataFrame([("p", 1, float(v)) for v in (1, 0, 1, 1, 1, 0)], ROWS)
    row = accuracy_by_group(df, ["problemname"], rebalance=False).first()
    assert row["count"] == 6
    assert row["var"] == pytest.approx(0.266667, abs=1e-6)
    assert row["conf95"] == pytest.approx(1.96 * row["sem"])


@pytest.mark.parametrize(
    "groups, count, mean, mean_sq, var, std, sem",
    [
        ([[1], [1, 0]], 2, 0.75, 0.375, -0.1875, None, None),
        ([[1, 1], [1, 1]], 4, 1, 1, 0, 0, 0),
        ([[1], [0]], 2, 0.5, 0, -0.25, None, None),
        ([[0], [0]], 2, 0, 0, 0, 0, 0),
    ],
)
def test_groups_of_one_row(spark, groups, count, mean, mean_sq, var, std, sem):
    row = stats(spark, groups)
    assert [row[c] for c in ("count", "mean", "mean_sq", "var", "std", "sem")] == [
        count, mean, mean_sq, var, std, sem
    ]


def test_size_collapses_before_problem_and_missing_keys_are_in_no_group(spark):
    rows = [
        ("a", 3, 1.0), ("a", 3, 0.0), ("a", 4, 1.0), ("a", 4, 1.0), ("a", 4, 1.0),
        ("b", 3, 0.0), ("b", 3, 0.0), ("b", None, 1.0), (None, 3, 1.0),
    ]
    df = spark.createDataFrame([("m", *r) for r in rows], "modelname string, " + ROWS)
    row = accuracy_by_group(df, ["modelname"]).first()
    # a: sizes 0.5 and 1.0, two rows each; b: 0.0, two rows; then two rows of each problem
    assert row["mean"] == pytest.approx((0.75 + 0.0) / 2)
    assert row["count"] == 4


def test_bias_is_the_same_over_another_field(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", -1.0)], "modelname string, bias double")
    row = bias_by_group(df, ["modelname"]).first()
    assert (row["mean"], row["count"], row["var"]) == (0, 2, 2)


def merged(children, rebalance):
    """The definition, row by row: missing terms add nothing, their count stays."""
    smallest = min(c for c, _, _ in children)
    n = total = squares = 0.0
    for count, mean, var in children:
        c = smallest if rebalance else count
        n += c
        total += 0 if mean is None else c * mean
        squares += 0 if var is None or mean is None else c * (var + mean * mean)
    if n == 0:
        return n, None, None
    mean = total / n
    return n, mean, squares / n - mean * mean


@pytest.mark.parametrize("rebalance", [True, False])
def test_merging_equals_its_definition(spark, rebalance):
    rng = random.Random(3)
    groups, rows = {}, []
    for g in range(60):
        for child in range(rng.randrange(1, 6)):
            count = rng.choice([0, 1, 2, 5, 40])
            mean = rng.random() if count else None
            var = rng.random() if count > 1 else None
            groups.setdefault(g, []).append((count, mean, var))
            rows.append((g, child, float(count), mean, var))
    schema = T.StructType.fromDDL("g int, child int, count double, mean double, var double")
    found = {r.g: r for r in regroup(["g"], spark.createDataFrame(rows, schema), rebalance).collect()}
    assert len(found) == len(groups)
    for g, children in groups.items():
        n, mean, var = merged(children, rebalance)
        row = found[g]
        assert row["count"] == n
        assert row["mean"] == pytest.approx(mean)
        assert row["var"] == pytest.approx(var, abs=1e-9)
        if var is not None and var > 1e-9:
            assert row["sem"] == pytest.approx(math.sqrt(var) / math.sqrt(n))
