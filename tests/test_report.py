"""Cells, display order, pivots and the standard report."""

import pytest
from pyspark.sql import functions as F

from evalgrid import accuracy_by_group, analyse_results_df, compute_acc_table, format_cell, pivot_pretty, sort_for_display
from evalgrid.plans import derived as D

SF = "/root/testdata/sf0.001"


def cell(spark, mean, sem, style, scale):
    df = spark.createDataFrame([(mean, sem)], "mean double, sem double")
    return df.select(format_cell("mean", "sem", style, scale).alias("c")).first().c


def test_cells(spark):
    assert cell(spark, 0.5, 0.25, "mean", 100) == 50
    assert cell(spark, 0.5, 0.25, "conf", 100) == pytest.approx(49)
    assert tuple(cell(spark, 0.5, 0.25, "tuple", 1)) == (0.5, pytest.approx(0.49))
    assert cell(spark, 0.476883, 0.0019413, "str", 100) == "47.7 (0.4)"
    assert cell(spark, -0.001, 0.005, "str", 1) == "-0.00 (0.01)"
    assert cell(spark, 0.5, None, "str", 100) == "50.0 (nan)"
    assert cell(spark, 0.5, 0.25, "latex", 100) == r"50.0{\tiny $\pm 49.0$}"
    assert cell(spark, 20.5, 0.0, "str", 100) == "2050.0 (0.0)"
    with pytest.raises(ValueError):
        format_cell("mean", "sem", "bold")


@pytest.mark.parametrize("value, scale, shown", [(0.0025, 100, "0.2"), (2.675, 1, "2.67"), (0.0075, 100, "0.8")])
def test_ties_round_like_python(spark, value, scale, shown):
    decimals = 1 if scale == 100 else 2
    assert f"{scale * value:.{decimals}f}" == shown
    assert cell(spark, value, 0.0, "str", scale).split(" ")[0] == shown


STATS = "prompting string, modelname string, problemname string, mean double, sem double"


def stats(spark):
    rows = [
        ("basic", "zeta", "Infer.normal", 0.1, 0.0), ("basic", "GPT4", "Infer.normal", 0.2, 0.0),
        ("basic", "alpha", "Infer.normal", 0.3, 0.0), ("basic", "GPT3.5", "odd", 0.4, 0.0),
        ("basic", "GPT4", "Infer.trivial", 0.5, 0.0), ("basic", "GPT4", "Compl.normal", 0.6, None),
    ]
    return spark.createDataFrame(rows, STATS)


def test_rows_and_columns_follow_the_preferred_order(spark):
    table = pivot_pretty(stats(spark), "problemname")
    assert table.columns == ["modelname", "Infer.trivial", "Infer.normal", "Compl.normal", "odd"]
    rows = table.collect()
    assert [r.modelname for r in rows] == ["GPT3.5", "GPT4", "alpha", "zeta"]
    assert rows[1]["Compl.normal"] == "60.0 (nan)" and rows[0]["Infer.normal"] is None


def test_sorting_for_display(spark):
    rows = sort_for_display(stats(spark).select("modelname", "problemname")).collect()
    assert [tuple(r) for r in rows] == [
        ("GPT3.5", "odd"), ("GPT4", "Infer.trivial"), ("GPT4", "Infer.normal"),
        ("GPT4", "Compl.normal"), ("alpha", "Infer.normal"), ("zeta", "Infer.normal"),
    ]


def test_index_that_leaves_out_a_key_shows_its_first_value(spark):
    table = pivot_pretty(stats(spark), "prompting", ["modelname"], cell_style="mean")
    assert {r.modelname: round(r.basic, 6) for r in table.collect()}["GPT4"] == 60.0  # Compl.normal


def test_rows_and_columns_without_numbers_are_left_out(spark):
    table = pivot_pretty(stats(spark), "problemname", ["modelname"], cell_style="conf")
    assert table.select("modelname", F.col("`Infer.trivial`")).count() == 4
    assert table.where("modelname = 'GPT4'").first()["Compl.normal"] is None


def test_other_shapes(spark):
    plain = pivot_pretty(stats(spark), index=["modelname", "problemname"])
    assert plain.columns == ["modelname", "problemname", "value"] and plain.count() == 6
    two = pivot_pretty(stats(spark), ["prompting", "problemname"])
    assert two.columns[1] == "basic | Infer.trivial"
    one_row = pivot_pretty(stats(spark).where("modelname = 'GPT4'"), "problemname")
    assert one_row.count() == 1 and len(one_row.columns) == 3
    with pytest.raises(ValueError):
        pivot_pretty(stats(spark).limit(1))


def test_report_equals_the_tables_one_by_one(spark):
    results = D.results(spark, SF).join(D.trials(spark, SF), "Key")
    report = analyse_results_df(results)
    scores = compute_acc_table(results)
    overall = pivot_pretty(accuracy_by_group(scores, ["prompting", "modelname"]), "prompting", ["modelname"])
    assert report.overall.collect() == overall.collect()
    by = ["prompting", "modelname", "problemname"]
    accuracy = pivot_pretty(accuracy_by_group(scores, by), "problemname", by[:2])
    assert report.accuracy.collect() == accuracy.collect()
    bias = pivot_pretty(accuracy_by_group(scores, by, accfield="bias"), "problemname", by[:2], scale=1.0)
    assert report.bias.collect() == bias.collect()
    assert report.accuracy.columns[2:] == list(D.PROBLEMS)


def test_single_problem_has_no_overall_table(spark):
    results = D.results(spark, SF).join(D.trials(spark, SF), "Key").where("problemname = 'Infer.normal'")
    assert analyse_results_df(results).overall is None
