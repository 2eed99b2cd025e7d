"""Every operator as a runnable query over the given tables, with its SQL counterpart.

A query takes the session and the folder of the tables. Queries about files first
write whole derived tables to the shared folder in the layout in question.
"""

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import evalgrid as eg
from evalgrid import constants as K
from evalgrid import schemas
from evalgrid.functions import labels, lookups, numbers
from evalgrid.operators import scoring
from evalgrid.plans import analyse
from evalgrid.plans import derived as D
from evalgrid.plans import oracle as O
from evalgrid.session import materialise, scratch_path
from evalgrid.sources import pieces, records
from evalgrid.sources import results as result_files
from evalgrid.sources import trials as trial_files
from evalgrid.streaming import growing, incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NO_EXTRA = T.StructType([])


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.assemble_trials_and_results_df(D.trials(spark, sf_dir), D.results(spark, sf_dir))


def assembled_with_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``assembled`` with the number of accepted answers in place of these: scoring needs no more of them."""
    sized = D.trials(spark, sf_dir).withColumn("expectedresp_len", F.array_size("expectedresp")).drop("expectedresp")
    return eg.assemble_trials_and_results_df(sized, D.results(spark, sf_dir))


def acc_table(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    return eg.compute_acc_table(assembled_with_sizes(spark, sf_dir), carry=carry)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that the order of a sum does not show."""
    return df.select(
        *(F.round(lookups.named(c), 6).alias(c) if t == "double" else lookups.named(c) for c, t in df.dtypes)
    )


# --- statistics ------------------------------------------------------------------

_MODEL = ("prompting", "modelname")
_PROBLEM = (*_MODEL, "problemname")
_SIZE = (*_PROBLEM, "problemsize")


def _rebalanced_ctes(
    field: str, by: tuple[str, ...], source: str = "acc", tag: str = ""
) -> tuple[list[str], str]:
    """Common tables collapsing size first and problem second, and the last one's name."""
    steps = [f for f in K.REBALANCED_FIELDS if f not in by]
    level, name = [*by, *steps], f"s{tag}0"
    ctes = [O.level0(source, level, field, name)]
    for n, f in enumerate(steps, 1):
        level.remove(f)
        ctes.append(O.merged(name, level, f"s{tag}{n}"))
        name = f"s{tag}{n}"
    return ctes, name


def _rebalanced(field: str, by: tuple[str, ...], source: str = "acc", *before: str) -> str:
    """SQL of the re-balanced statistics."""
    ctes, name = _rebalanced_ctes(field, by, source)
    return O.query(O.shown(name, by, O.POOLED if len(ctes) > 1 else O.PLAIN), *before, *ctes)


@registered(_rebalanced("acc", _MODEL))
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, *_SIZE)
    return rounded(eg.accuracy_by_group(scores, _MODEL))


@registered(_rebalanced("acc", _PROBLEM))
def accuracy_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, *_SIZE)
    return rounded(eg.accuracy_by_group(scores, _PROBLEM))


@registered(_rebalanced("bias", _PROBLEM))
def bias_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, *_SIZE)
    return rounded(eg.bias_by_group(scores, _PROBLEM))


@registered(_rebalanced("acc", ("modelname", "problemsize")))
def accuracy_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems are averaged out, sizes are kept apart."""
    scores = acc_table(spark, sf_dir, *_SIZE)
    return rounded(eg.accuracy_by_group(scores, ("modelname", "problemsize")))


@registered(
    O.query(
        O.shown("s0", K.DEFAULT_BY, O.PLAIN),
        f"fine AS (SELECT *, {O.case('query_len', K.ARITY_NAME)} AS bintern FROM acc)",
        O.level0("fine", K.DEFAULT_BY, "acc", "s0"),
    )
)
def accuracy_by_default_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, *_SIZE, "complexity", "query_len")
    return rounded(eg.accuracy_by_group(eg.add_bintern_and_globcomplex_fields(scores)))


@registered(
    O.query(O.shown("s0", _MODEL, O.PLAIN), O.level0("acc", _MODEL, "acc", "s0"))
)
def stats_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, "prompting")
    return rounded(eg.accuracy_by_group(scores, _MODEL, rebalance=False))


@registered(
    O.query(O.shown("s0", _SIZE, O.PLAIN, conf95=False), O.level0("acc", _SIZE, "bias", "s0"))
)
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eg.group_stats(acc_table(spark, sf_dir, *_SIZE), _SIZE, "bias"))


@registered(
    O.query(
        O.shown("s1", _PROBLEM, O.POOLED, conf95=False),
        O.level0("acc", _SIZE, "acc", "s0"),
        O.merged("s0", _PROBLEM, "s1", rebalance=False),
    )
)
def regroup_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = eg.group_stats(acc_table(spark, sf_dir, *_SIZE), _SIZE, "acc")
    return rounded(eg.regroup(_PROBLEM, stats, rebalance=False))


_DOMAIN = ("modelname", "domain", "intraining")


def _by_labels(by: tuple[str, ...], source: str, labelled: str) -> str:
    """SQL of re-balanced accuracy by labels of the trial that an accuracy row kept."""
    fine = (
        f"fine AS (SELECT a.* EXCLUDE (problemname), t.problemname, {labelled} "
        f'FROM acc a JOIN {source} t ON t."Key" = a."Key")'
    )
    return _rebalanced("acc", by, "fine", fine)


@registered(
    _by_labels(
        _DOMAIN,
        "trials",
        f"{O.case('t.skin', K.SKIN_DOMAIN)} AS domain, {O.case('t.skin', K.SKIN_TRAINING)} AS intraining",
    )
)
def accuracy_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples with an unknown skin have no domain and are in no group."""
    scores = acc_table(spark, sf_dir, *_SIZE, "skin")
    return rounded(eg.accuracy_by_group(eg.add_skin_categorization_fields(scores), _DOMAIN))


_CATEGORY = ("modelname", "problem_category", "problem_normaltrivial")


@registered(
    _by_labels(
        _CATEGORY,
        "older_trials",
        f"{O.case('t.problemname', K.PROBLEM_CATEGORY)} AS problem_category, "
        f"{O.case('t.problemname', K.PROBLEM_DIFFICULTY)} AS problem_normaltrivial",
    )
)
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = eg.assemble_trials_and_results_df(
        D.older_trials(spark, sf_dir), D.results(spark, sf_dir)
    )
    scores = eg.compute_acc_table(answered, carry=_SIZE)
    return rounded(eg.accuracy_by_group(eg.add_problem_categorization_fields(scores), _CATEGORY))


# --- scoring -----------------------------------------------------------------------


@registered(
    O.query(
        f'SELECT "Key", goldresp, {O.case("goldresp", K.GOLD_WEIGHT)}::DOUBLE AS acc_weight FROM trials'
    )
)
def gold_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trials(spark, sf_dir).select(
        "Key", "goldresp", lookups.gold_weight("goldresp").alias("acc_weight")
    )


@registered(
    O.query(
        f'SELECT "Key", modelname, resp, {O.case("resp", K.ANSWER_BIAS)}::DOUBLE AS bias FROM results'
    )
)
def resp_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.results(spark, sf_dir).select(
        "Key", "modelname", "resp", lookups.response_bias("resp").alias("bias")
    )


@registered(O.query('SELECT "Key", modelname, resp, goldresp, acc FROM scored'))
def folded_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(spark, sf_dir).select(
        "Key", "modelname", "resp", "goldresp",
        lookups.folded_accuracy("resp", "goldresp").alias("acc"),
    )


@registered(O.query('SELECT modelname, "Key", tuple_ID, tuplelen FROM sized'))
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.with_group_size(assembled(spark, sf_dir)).select(
        "modelname", "Key", "tuple_ID", "tuplelen"
    )


@registered(
    O.query(
        'SELECT modelname, "Key", resp, tuplelen, expectedresp_len FROM sized '
        "WHERE tuplelen = expectedresp_len"
    )
)
def complete_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.filter_complete_tuples(assembled(spark, sf_dir)).select(
        "modelname", "Key", "resp", "tuplelen", "expectedresp_len"
    )


@registered(
    O.query(
        f"""SELECT modelname, problemname,
  {O.rounded("coalesce(sum(acc * acc_weight), 0) / nullif(sum(acc_weight), 0)", "acc")},
  {O.rounded("coalesce(sum(bias * acc_weight), 0) / nullif(sum(acc_weight), 0)", "bias")}
FROM scored GROUP BY modelname, problemname"""
    )
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.add_score_columns(assembled(spark, sf_dir))
    return rounded(
        eg.weighted_means_by_group(scored, ("modelname", "problemname"), ["acc", "bias"], "acc_weight")
    )


def _over_tuple(field: str) -> str:
    window = "OVER (PARTITION BY modelname, tuple_ID)"
    return (
        f"coalesce(sum({field} * acc_weight) {window}, 0) / nullif(sum(acc_weight) {window}, 0)"
    )


@registered(
    O.query(
        f'SELECT modelname, "Key", {O.rounded(_over_tuple("acc"), "acc")}, '
        f'{O.rounded(_over_tuple("bias"), "bias")} FROM scored'
    )
)
def weighted_mean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.add_score_columns(assembled(spark, sf_dir))
    means = eg.transform_into_weighted_mean(
        scored, scoring.TUPLE_KEYS, ["acc", "bias"], "acc_weight"
    )
    return rounded(means.select("modelname", "Key", "acc", "bias"))


@registered(
    O.query(
        "SELECT modelname, problemname, problemsize, "
        "min(count) OVER (PARTITION BY prompting, modelname, problemname) AS count FROM s0",
        O.level0("acc", _SIZE, "acc", "s0"),
    )
)
def sibling_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = eg.group_stats(acc_table(spark, sf_dir, *_SIZE), _SIZE, "acc")
    return eg.with_group_minimum(stats, _PROBLEM, "count").select(
        "modelname", "problemname", "problemsize", "count"
    )


@registered(
    O.query(
        "SELECT modelname, tuple_ID, min(\"Key\") AS \"Key\", arg_min(resp, \"Key\") AS resp, "
        "arg_min(goldresp, \"Key\") AS goldresp, arg_min(text, \"Key\") AS text "
        "FROM assembled GROUP BY modelname, tuple_ID"
    )
)
def first_row_per_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembled(spark, sf_dir).select(
        "modelname", "tuple_ID", "prompting", "Key", "resp", "goldresp", "text"
    )
    return eg.first_row_per_group(rows).drop("prompting")


_ACC_COLUMNS = (
    "modelname", "tuple_ID", "Key", "prompting", "problemname", "problemsize", "skin",
    "complexity", "query_len", "tuplelen", "expectedresp_len", "acc", "bias",
)
_ACC_ROWS = O.query(f"SELECT {', '.join(_ACC_COLUMNS)} FROM acc")


@registered(_ACC_ROWS)
def acc_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.compute_acc_table(assembled_with_sizes(spark, sf_dir)).select(*_ACC_COLUMNS)


@registered(_ACC_ROWS)
def acc_table_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = eg.compute_acc_table(assembled_with_sizes(spark, sf_dir), uniform_lengths=True)
    return scores.select(*_ACC_COLUMNS)


@registered(
    O.query(
        """SELECT modelname, tuple_ID, min("Key") AS "Key",
  coalesce(sum(acc * acc_weight), 0) / nullif(sum(acc_weight), 0) AS acc,
  coalesce(sum(bias * acc_weight), 0) / nullif(sum(acc_weight), 0) AS bias
FROM scored GROUP BY modelname, tuple_ID"""
)
)
def acc_table_all_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomplete tuples are scored on the rows they have."""
    return eg.compute_acc_table(
        assembled(spark, sf_dir), filter_incomplete_tuples=False, carry=["Key"]
    )


_TWICE = """twice AS (
  SELECT * FROM scored UNION ALL
  SELECT * REPLACE ('COT' AS prompting) FROM scored WHERE modelname = 'GPT4'
),
twice_sized AS (
  SELECT *, count(*) OVER (PARTITION BY modelname, tuple_ID) AS n,
         count(*) OVER (PARTITION BY modelname, prompting, tuple_ID) AS n_prompting
  FROM twice
)"""


def _two_promptings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembled(spark, sf_dir)
    again = rows.where(F.col("modelname") == "GPT4").withColumn("prompting", F.lit("COT"))
    return rows.unionByName(again)


@registered(
    O.query(
        """SELECT modelname, tuple_ID, prompting, sum(acc * acc_weight) / sum(acc_weight) AS acc
FROM twice_sized WHERE n_prompting = len(expectedresp) GROUP BY modelname, tuple_ID, prompting""",
        _TWICE,
    )
)
def acc_table_per_prompting(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("modelname", "tuple_ID", "prompting")
    scores = eg.compute_acc_table(_two_promptings(spark, sf_dir), tuple_keys=keys, carry=[])
    return scores.select(*keys, "acc")


@registered(
    O.query(
        """SELECT modelname, count(DISTINCT tuple_ID) AS n_tuples FROM twice_sized
WHERE n = len(expectedresp) GROUP BY modelname""",
        _TWICE,
    )
)
def overfull_tuples_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By default a model that answered under two promptings has no complete tuples."""
    scores = eg.compute_acc_table(_two_promptings(spark, sf_dir), carry=[])
    return scores.groupBy("modelname").agg(F.count(F.lit(1)).alias("n_tuples"))


# --- derived fields -------------------------------------------------------------------


@registered(
    O.query(
        f'SELECT "Key", {O.case("goldresp", K.GOLD_TO_HIDDEN, "goldresp")} AS goldresp_obfusc FROM trials'
    )
)
def obfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.obfuscate_goldresp(D.trials(spark, sf_dir).select("Key", "goldresp"))


@registered(O.query('SELECT "Key", goldresp FROM trials'))
def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = eg.obfuscate_goldresp(D.trials(spark, sf_dir).select("Key", "goldresp"))
    return eg.deobfuscate_goldresp(hidden)


_ARITY = O.case("query_len", K.ARITY_NAME)
_LEVEL = f"least({O.case('complexity', K.COMPLEXITY_LEVEL)} + query_len - 2, 2)::INTEGER"
_IS_CONTROL = f"list_contains({O.array(K.CONTROL_PROBLEMS)}, problemname)"
_FINE = f"""{_ARITY} AS bintern, {_LEVEL} AS globcomplex,
  {_IS_CONTROL} AS is_control_experiment,
  {O.case("problemname", K.PROBLEM_CATEGORY)} AS problem_category,
  {O.case("problemname", K.PROBLEM_DIFFICULTY)} AS problem_normaltrivial,
  {O.case("skin", K.SKIN_DOMAIN)} AS domain, {O.case("skin", K.SKIN_TRAINING)} AS intraining"""


@registered(O.query(f'SELECT "Key", {_ARITY} AS bintern, {_LEVEL} AS globcomplex FROM trials'))
def bintern_globcomplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.add_bintern_and_globcomplex_fields(D.trials(spark, sf_dir)).select(
        "Key", "bintern", "globcomplex"
    )


@registered(
    O.query(
        f"""SELECT "Key", problemname, {_IS_CONTROL} AS is_control_experiment,
  {O.case("problemname", K.PROBLEM_CATEGORY)} AS problem_category,
  {O.case("problemname", K.PROBLEM_DIFFICULTY)} AS problem_normaltrivial
FROM (SELECT * FROM older_trials UNION ALL SELECT * FROM trials)"""
    )
)
def problem_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eg.stack([D.older_trials(spark, sf_dir), D.trials(spark, sf_dir)])
    return eg.add_problem_categorization_fields(rows).select(
        "Key", "problemname", "is_control_experiment", "problem_category", "problem_normaltrivial"
    )


@registered(
    O.query(
        f'SELECT "Key", skin, {O.case("skin", K.SKIN_DOMAIN)} AS domain, '
        f'{O.case("skin", K.SKIN_TRAINING)} AS intraining FROM trials'
    )
)
def skin_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.add_skin_categorization_fields(D.trials(spark, sf_dir)).select(
        "Key", "skin", "domain", "intraining"
    )


_FINE_COLUMNS = (
    "Key", "bintern", "globcomplex", "is_control_experiment", "problem_category",
    "problem_normaltrivial", "domain", "intraining",
)


@registered(O.query(f'SELECT "Key", {_FINE} FROM older_trials'))
def all_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eg.add_fields_for_finegrained_analysis(D.older_trials(spark, sf_dir))
    return rows.select(*_FINE_COLUMNS)


@registered(O.query('SELECT "Key", query_len, 0 AS clarified, 0 AS context_nb FROM trials'))
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.trials(spark, sf_dir).select("Key", "query_len")
    return eg.add_missing_columns(rows, query_len=9, clarified=0, context_nb=0)


# --- display tables ---------------------------------------------------------------------


def _cell(mean: str, sem: str, scale: int, latex: bool = False) -> str:
    """SQL of a text cell, of figures rounded to six decimals."""
    decimals = 1 if scale == 100 else 2
    form = "{:." + str(decimals) + "f}"
    value = f"coalesce(format('{form}', {scale}::DOUBLE * {mean}), 'nan')"
    conf = f"coalesce(format('{form}', {scale * K.CONF95}::DOUBLE * {sem}), 'nan')"
    if latex:
        return f"{value} || '{{\\tiny $\\pm ' || {conf} || '$}}'"
    return f"{value} || ' (' || {conf} || ')'"


def _stats_ctes(field: str, by: tuple[str, ...], tag: str = "", source: str = "acc") -> list[str]:
    """Common tables ending in ``st`` and the tag: re-balanced, rounded statistics."""
    ctes, name = _rebalanced_ctes(field, by, source, tag)
    shown = [*by, O.rounded("mean", "mean"), O.rounded("sem", "sem")]
    return [*ctes, f"st{tag} AS (SELECT {', '.join(shown)} FROM {name})"]


def _stats(spark: SparkSession, sf_dir: str, field: str, by: tuple[str, ...]) -> DataFrame:
    """Rounded statistics, computed once because a pivot reads them more than once."""
    scores = acc_table(spark, sf_dir, *_SIZE)
    stats = eg.accuracy_by_group(scores, by, accfield=field)
    return materialise(rounded(stats), "stats")


@registered(
    O.query(
        f"""SELECT prompting, modelname, problemname,
  {O.rounded("100 * mean", "mean")}, {O.rounded("100 * 1.96 * sem", "conf")},
  {O.rounded("mean", "tuple_mean")}, {O.rounded("1.96 * sem", "tuple_conf")},
  {_cell("mean", "sem", 100)} AS percent, {_cell("mean", "sem", 1)} AS share,
  {_cell("mean", "sem", 100, latex=True)} AS latex
FROM st""",
        *_stats_ctes("bias", _PROBLEM),
    )
)
def cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = acc_table(spark, sf_dir, *_SIZE)
    stats = rounded(eg.bias_by_group(scores, _PROBLEM))
    pair = eg.format_cell("mean", "sem", "tuple", 1)
    return rounded(stats.select(
        *_PROBLEM,
        eg.format_cell("mean", "sem", "mean").alias("mean"),
        eg.format_cell("mean", "sem", "conf").alias("conf"),
        pair["mean"].alias("tuple_mean"),
        pair["conf"].alias("tuple_conf"),
        eg.format_cell("mean", "sem", "str").alias("percent"),
        eg.format_cell("mean", "sem", "str", 1).alias("share"),
        eg.format_cell("mean", "sem", "latex").alias("latex"),
    ))


_RANKS = {v: i for i, v in enumerate(K.DISPLAY_ORDER["problemname"])}


@registered(
    O.query(
        f"""SELECT problemname, {O.case("problemname", _RANKS, str(len(_RANKS)))} AS label_rank,
  count(*) AS n FROM (
    SELECT problemname FROM trials UNION ALL SELECT problemname FROM older_trials
    UNION ALL SELECT skin FROM trials)
GROUP BY problemname"""
    )
)
def ordered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in display order; skins stand in for labels without a preferred place."""
    new, old = D.trials(spark, sf_dir), D.older_trials(spark, sf_dir)
    names = [new.select("problemname"), old.select("problemname"),
             new.select(F.col("skin").alias("problemname"))]
    counted = eg.stack(names).groupBy("problemname").agg(F.count(F.lit(1)).alias("n"))
    rank = labels.label_rank("problemname", "problemname").alias("label_rank")
    return eg.sort_for_display(counted).select("problemname", rank, "n")


def _heads(cell: str) -> str:
    return ", ".join(
        f"max({cell}) FILTER (problemname = {O.text(p)}) AS \"{p}\"" for p in D.PROBLEMS
    )


@registered(
    O.query(
        f'SELECT modelname, max({_cell("mean", "sem", 100)}) AS basic FROM st GROUP BY modelname',
        *_stats_ctes("acc", _MODEL),
    )
)
def pivot_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.pivot_pretty(_stats(spark, sf_dir, "acc", _MODEL), ["prompting"], ["modelname"])


@registered(
    O.query(
        f'SELECT prompting, modelname, {_heads(_cell("mean", "sem", 100))} FROM st '
        "GROUP BY prompting, modelname",
        *_stats_ctes("acc", _PROBLEM),
    )
)
def pivot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir, "acc", _PROBLEM)
    return eg.pivot_pretty(stats, "problemname", ["prompting", "modelname"])


@registered(
    O.query(
        f'SELECT prompting, modelname, {_heads(_cell("mean", "sem", 1))} FROM st '
        "GROUP BY prompting, modelname",
        *_stats_ctes("bias", _PROBLEM),
    )
)
def pivot_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir, "bias", _PROBLEM)
    return eg.pivot_pretty(stats, "problemname", ["prompting", "modelname"], scale=1.0)


@registered(
    O.query(
        "SELECT modelname, "
        + ", ".join(
            f"{O.rounded(f'max(100 * mean) FILTER (problemname = {O.text(p)})', chr(34) + p + chr(34))}"
            for p in D.PROBLEMS
        )
        + " FROM st GROUP BY modelname",
        *_stats_ctes("acc", _PROBLEM),
    )
)
def auto_index_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompting`` has one value and is left out of the index."""
    stats = _stats(spark, sf_dir, "acc", _PROBLEM)
    return rounded(eg.pivot_pretty(stats, "problemname", cell_style="mean"))


@registered(
    O.query(
        "SELECT modelname, arg_min("
        + _cell("mean", "sem", 100)
        + ", problemname) AS basic FROM st GROUP BY modelname",
        *_stats_ctes("acc", _PROBLEM),
    )
)
def pivot_first_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that leaves out the problem shows the first problem's cell."""
    return eg.pivot_pretty(_stats(spark, sf_dir, "acc", _PROBLEM), "prompting", ["modelname"])


def _report_sql() -> str:
    parts, ctes = [], []
    tables = {"overall": ("acc", _MODEL), "accuracy": ("acc", _PROBLEM), "bias": ("bias", _PROBLEM)}
    for name, (field, by) in tables.items():
        ctes += _stats_ctes(field, by, f"_{name}_")
        problem = "problemname" if "problemname" in by else "NULL::VARCHAR AS problemname"
        parts.append(
            f"SELECT {O.text(name)} AS report, prompting, modelname, {problem}, mean, sem FROM st_{name}_"
        )
    return O.query("\nUNION ALL ".join(parts), *ctes)


@registered(_report_sql())
def report_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the standard report out of one pass over the responses."""
    base = analyse.kept_finest_stats(assembled(spark, sf_dir))
    named = zip(("overall", "accuracy", "bias"), analyse.report_stats(base), strict=True)
    parts = []
    for name, stats in named:
        if "problemname" not in stats.columns:
            stats = stats.withColumn("problemname", F.lit(None).cast("string"))
        parts.append(
            stats.select(F.lit(name).alias("report"), *_PROBLEM, "mean", "sem")
        )
    return rounded(eg.stack(parts))


@registered(
    O.query(
        "SELECT count(DISTINCT problemname) AS problemname, count(DISTINCT modelname) AS modelname, "
        "count(DISTINCT prompting) AS prompting FROM acc"
    )
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taken from the small statistics table, as the report's first question."""
    stats = eg.group_stats(acc_table(spark, sf_dir, *_SIZE), _PROBLEM, "acc")
    names = ("problemname", "modelname", "prompting")
    return stats.agg(*(F.count_distinct(n).alias(n) for n in names))


# --- files ----------------------------------------------------------------------------------


def _in_order(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Trials in the order of their keys, in parts as large as those of ``D.spread_orders``."""
    return rows.repartitionByRange(D.n_tasks(spark, sf_dir), "Key").sortWithinPartitions("Key")


def _stored_trials(spark: SparkSession, sf_dir: str, extension: str, codec: str, sort: bool = False) -> str:
    """Write the trials as a test set keeps them; returns the trials file."""
    rows = eg.obfuscate_goldresp(D.trials(spark, sf_dir, None if sort else D.spread_orders(spark, sf_dir)))
    path = f"{scratch_path(spark, 'testset')}/trials.{extension}"
    rows = _in_order(spark, sf_dir, rows) if sort else rows
    rows.write.option("compression", codec).json(path)
    return path


def _packed_trials(spark: SparkSession, sf_dir: str) -> str:
    """``_stored_trials`` as bzip2, packed by the tasks where they reach the files."""
    path = f"{scratch_path(spark, 'testset')}/{K.TESTSET_FILE}"
    rows = eg.obfuscate_goldresp(D.trials(spark, sf_dir, D.spread_orders(spark, sf_dir)))
    if pieces.reaches(path):
        lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
        if lines.mapInArrow(pieces.bzip2_in(path), "path string").count():
            return path
    # a folder without files would be none
    rows.write.mode("append").option("compression", "bzip2").json(path)
    return path


def _stored_results(spark: SparkSession, sf_dir: str, directory: str) -> None:
    rows = D.results(spark, sf_dir, D.spread_orders(spark, sf_dir))
    for model in D.MODELS:
        mine = rows.where(F.col("modelname") == model)
        eg.write_results(mine, directory, D.PROMPTING, model)


_STORED = (
    "Key", "text", "goldresp", "problemname", "problemsize", "skin", "tuple_ID", "complexity",
    "query_len",
)
_FLAT = f"{', '.join(_STORED)}, array_to_string(expectedresp, '|') AS expectedresp"


def _flat(df: DataFrame) -> DataFrame:
    """Trials with the list of accepted answers as one text."""
    return df.select(*_STORED, F.array_join("expectedresp", "|").alias("expectedresp"))


@registered(O.query('SELECT "Key", resp, modelname, prompting FROM results'))
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of each model written to a file of its own, all read in one scan."""
    directory = f"{scratch_path(spark, 'testset')}/results"
    _stored_results(spark, sf_dir, directory)
    return eg.load_results_as_dataframe(spark, f"{directory}/*{K.RESULTS_ENDING}")


@registered(
    "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS prompting, "
    "replace(c_name, '#', '+') AS modelname FROM customer"
)
def filename_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels out of percent-encoded paths, one for each customer."""
    customers = D.table(spark, sf_dir, "customer")
    label = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    model = F.replace("c_name", F.lit("#"), F.lit("+"))
    name = F.concat(label, F.lit("___"), model, F.lit("___results.jsonl/part-00000.json"))
    encoded = F.replace(F.concat(F.lit("file:/a b/results/"), name), F.lit(" "), F.lit("%20"))
    paths = customers.select("c_custkey", encoded.alias("path"))
    return labels.with_labels(paths, "path").select("c_custkey", "prompting", "modelname")


@registered(
    O.query(
        f"SELECT prompting || '___' || modelname || '{K.RESULTS_ENDING}' AS name, count(*) AS n_records, "
        "0::BIGINT AS n_corrupt FROM results GROUP BY prompting, modelname"
    )
)
def results_files_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results files below a folder, and how many records each holds."""
    directory = scratch_path(spark, "testset")
    _stored_results(spark, sf_dir, f"{directory}/results")
    found = eg.find_files_ending_in(spark, directory, K.RESULTS_ENDING).select("path")
    held = records.corrupt_records(spark, f"{directory}/results/*{K.RESULTS_ENDING}", schemas.RESULTS)
    held = held.withColumn("path", labels.plain_path("path"))
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    return found.select(name).join(held.select(name, "n_records", "n_corrupt"), "name")


@registered(O.query(f"SELECT {_FLAT} FROM trials"))
def trials_bzip2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_trials(spark, sf_dir, "jsonl.bz2", "bzip2")
    return _flat(eg.load_trials_as_dataframe(spark, path, include_expname_fields=False))


@registered(O.query(f"SELECT {_FLAT} FROM trials"))
def trials_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read with the schema given, so without a look ahead."""
    path = _stored_trials(spark, sf_dir, "jsonl.gz", "gzip")
    return _flat(
        eg.load_trials_as_dataframe(spark, path, include_expname_fields=False, extra=NO_EXTRA)
    )


@registered(
    O.query(
        'SELECT "Key", goldresp, \'testset\' AS EXPNAME, '
        'row_number() OVER (ORDER BY "Key") - 1 AS EXP_i FROM trials'
    )
)
def trials_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers follow the file, which is written in the order of the keys."""
    path = _stored_trials(spark, sf_dir, "jsonl", "none", sort=True)
    return eg.load_trials_as_dataframe(spark, path).select("Key", "goldresp", "EXPNAME", "EXP_i")


@registered(O.query(f'SELECT "Key", {_FINE} FROM trials'))
def testset_with_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_trials(spark, sf_dir, "jsonl.bz2", "bzip2")
    folder = path.rpartition("/")[0]
    return eg.load_testset(spark, folder, add_extra_fields=True).select(*_FINE_COLUMNS)


@registered(O.query('SELECT "Key", goldresp, tuple_ID FROM trials'))
def experiment_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader finds the trials file of an experiment folder."""
    path = _stored_trials(spark, sf_dir, "jsonl", "none")
    return eg.load_as_dataframe(spark, path.rpartition("/")[0]).select("Key", "goldresp", "tuple_ID")


@registered(
    O.query(
        "SELECT \"Key\", goldresp, problemsize, array_to_string(expectedresp, '|') AS expectedresp "
        "FROM trials"
    )
)
def columns_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the form ``{"column": {"row": value}}``, of 300 rows each."""
    # the block follows the place of a row, so no key makes a block any larger
    rows = D.trials(spark, sf_dir).withColumn("place", F.monotonically_increasing_id())

    def column_of(name: str):
        return F.map_from_entries(
            F.transform("rows", lambda x: F.struct(x["i"].cast("string"), x["r"][name]))
        ).alias(name)

    names = ("Key", "goldresp", "problemsize", "expectedresp")
    gathered = F.collect_list(F.struct(F.col("place").alias("i"), F.struct(*names).alias("r")))
    blocks = (
        rows.withColumn("block", F.expr("place div 300"))
        .groupBy("block")
        .agg(gathered.alias("rows"))
    )
    texts = blocks.select(
        F.concat(F.lit("block-"), F.col("block").cast("string")).alias(records.PATH),
        F.to_json(F.struct(*(column_of(n) for n in names))).alias("value"),
    )
    schema = T.StructType([schemas.TRIALS[n] for n in names])
    return records.records_from_columns(texts, schema).select(
        "Key", "goldresp", "problemsize", F.array_join("expectedresp", "|").alias("expectedresp")
    )


@registered(O.query('SELECT "Key", text, goldresp FROM trials'))
def zip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of JSON-Lines, one for every batch of trials, unpacked and parsed."""
    lines = D.trials(spark, sf_dir).select(
        F.to_json(F.struct("Key", "text", "goldresp")).alias("value")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, batch in enumerate(batches):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("trials.jsonl", "\n".join(batch["value"]))
            yield pd.DataFrame({"path": [f"{n}.jsonl.zip"], "content": [held.getvalue()]})

    archives = lines.mapInPandas(pack, "path string, content binary")
    schema = T.StructType([schemas.TRIALS[n] for n in ("Key", "text", "goldresp")])
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return records.unzip_texts(archives).select(parsed.alias("r")).select("r.*")


def _with_cut_records(spark: SparkSession, sf_dir: str) -> str:
    """Results of all models in which some records are cut off in the middle; returns their pattern."""
    directory = f"{scratch_path(spark, 'testset')}/results"
    key = F.col("Key")
    line = F.to_json(F.struct("Key", "resp"))
    cut = F.when(key % 101 == 0, line.substr(F.lit(1), F.length(line) - 3)).otherwise(line)
    rows = D.results(spark, sf_dir)
    for model in D.MODELS:
        mine = rows.where(F.col("modelname") == model)
        mine.select(cut.alias("value")).write.text(result_files.results_path(directory, D.PROMPTING, model))
    return f"{directory}/*{K.RESULTS_ENDING}"


@registered(O.query('SELECT "Key", modelname, resp FROM results WHERE "Key" % 101 <> 0'))
def corrupt_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut off in the middle are left out, all others are kept."""
    rows = eg.load_results_as_dataframe(spark, _with_cut_records(spark, sf_dir), skip_corrupt=True)
    return rows.select("Key", "modelname", "resp")


@registered(
    O.query(
        'SELECT modelname, count(*) AS n_records, count(*) FILTER ("Key" % 101 = 0) AS n_corrupt '
        "FROM results GROUP BY modelname"
    )
)
def corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each file ``skip_corrupt`` leaves out."""
    counted = records.corrupt_records(spark, _with_cut_records(spark, sf_dir), schemas.RESULTS)
    return labels.with_labels(counted, "path").select("modelname", "n_records", "n_corrupt")


def _with_cut_tails(spark: SparkSession, sf_dir: str, within: bool) -> str:
    """Results of all models in the order of their keys, the last record of each cut off; with ``within`` others as well."""
    directory = f"{scratch_path(spark, 'testset')}/results"
    rows = D.results(spark, sf_dir)
    ends = rows.groupBy("modelname").agg(F.max("Key").alias("end"))
    line = F.to_json(F.struct("Key", "resp"))
    is_cut = (F.col("Key") == F.col("end")) | ((F.col("Key") % 101 == 0) & F.lit(within))
    cut = F.when(is_cut, line.substr(F.lit(1), F.length(line) - 3)).otherwise(line)
    rows = rows.join(F.broadcast(ends), "modelname").select("Key", "modelname", cut.alias("value"))
    for model in D.MODELS:
        mine = rows.where(F.col("modelname") == model).orderBy("Key")
        mine.select("value").write.text(result_files.results_path(directory, D.PROMPTING, model))
    return f"{directory}/*{K.RESULTS_ENDING}"


@registered(
    O.query(
        'SELECT "Key", prompting, modelname, resp FROM results AS r '
        'WHERE "Key" < (SELECT max("Key") FROM results AS o WHERE o.modelname = r.modelname)'
    )
)
def cut_off_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last record of each file is cut off, as a crash leaves it; any other damage would fail."""
    rows = eg.load_results_as_dataframe(spark, _with_cut_tails(spark, sf_dir, within=False), cut_tail=True)
    return rows.select("Key", "prompting", "modelname", "resp")


@registered(
    O.query(
        'SELECT modelname, count(*) AS n_records, count(*) FILTER ("Key" % 101 = 0 AND "Key" < last) AS n_damaged, '
        '1::BIGINT AS n_cut_off FROM (SELECT *, max("Key") OVER (PARTITION BY modelname) AS last FROM results) '
        "GROUP BY modelname"
    )
)
def damage_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of each file, the one at its end apart from those within."""
    counted = eg.damage_by_place(spark, _with_cut_tails(spark, sf_dir, within=True), schemas.RESULTS)
    return labels.with_labels(counted, "path").drop("path", "prompting")


@registered(
    O.query(
        'SELECT "Key", goldresp, \'testset\' AS EXPNAME, row_number() OVER (ORDER BY "Key") - 1 AS EXP_i, '
        "'note ' || \"Key\" AS note, (\"Key\" % 7) / 2 AS half FROM trials"
    )
)
def row_index_from_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers and the types of other fields from the directory of splits that an earlier load has stored."""
    rows = eg.obfuscate_goldresp(D.trials(spark, sf_dir))
    note = F.concat(F.lit("note "), F.col("Key").cast("string"))
    rows = _in_order(spark, sf_dir, rows.withColumns({"note": note, "half": (F.col("Key") % 7) / 2}))
    path = f"{scratch_path(spark, 'testset')}/{K.TESTSET_FILE}"
    rows.write.option("compression", "bzip2").json(path)
    eg.load_testset(spark, path.rpartition("/")[0])
    again = eg.load_testset(spark, path.rpartition("/")[0])
    return again.select("Key", "goldresp", "EXPNAME", "EXP_i", "note", "half")


# Rows of a document; each is a folder with a file, which takes longer to make and find than some MB do to read.
_DOCUMENT_ROWS = 10_000


def _documents(spark: SparkSession, sf_dir: str, ending: str, codec: str, columns: bool = False) -> str:
    """Trials in JSON documents, one for every batch of rows; returns their folder's pattern."""
    names = ["Key", "text", "goldresp", "problemsize", "expectedresp"]
    rows = D.trials(spark, sf_dir, D.spread_orders(spark, sf_dir)).select(*names)
    pieces = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.expr(f"place div {_DOCUMENT_ROWS}"))
    gathered = F.collect_list(F.struct(F.col("place").alias("i"), F.struct(*names).alias("r")))
    pieces = pieces.groupBy("block").agg(gathered.alias("rows"))

    def column_of(name: str):
        return F.map_from_entries(
            F.transform("rows", lambda x: F.struct(x["i"].cast("string"), x["r"][name]))
        ).alias(name)

    as_columns = F.to_json(F.struct(*(column_of(n) for n in names)))
    value = as_columns if columns else F.to_json(F.transform("rows", lambda x: x["r"]))
    # a folder for each document: the text source writes a file for each row of it
    root = scratch_path(spark, "documents")
    writer = pieces.select(value.alias("value"), F.concat("block", F.lit(ending)).alias("document"))
    writer.write.partitionBy("document").option("compression", codec).text(root)
    return f"{root}/document=*{ending}"


_DOCUMENT = T.StructType([schemas.TRIALS[n] for n in ("Key", "text", "goldresp", "problemsize", "expectedresp")])
_DOCUMENT_SQL = O.query(
    "SELECT \"Key\", text, goldresp, problemsize, array_to_string(expectedresp, '|') AS expectedresp FROM trials"
)


def _read_documents(spark: SparkSession, paths: str) -> DataFrame:
    rows = records.read_json(spark, paths, _DOCUMENT)
    return rows.withColumn("expectedresp", F.array_join("expectedresp", "|"))


@registered(_DOCUMENT_SQL)
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists of records, through the reader."""
    return _read_documents(spark, _documents(spark, sf_dir, ".json", "none"))


@registered(_DOCUMENT_SQL)
def json_lists_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into records while they are read, as large ones are."""
    rows = records.read_json(spark, _documents(spark, sf_dir, ".json", "none"), _DOCUMENT, large=0)
    return rows.withColumn("expectedresp", F.array_join("expectedresp", "|"))


def _damaged_documents(spark: SparkSession, sf_dir: str) -> str:
    """Lists of records in which keys that end in 3 are no numbers."""
    texts = spark.read.text(_documents(spark, sf_dir, ".json", "none"), wholetext=True)
    root = scratch_path(spark, "damaged.json")
    damaged = F.regexp_replace(F.trim("value"), '"Key":([0-9]*3),', '"Key":no$1,')
    # a task writes a file, and a file is a document
    texts.select(damaged.alias("value"), F.concat(F.xxhash64("value"), F.lit(".json")).alias("document")).write.partitionBy("document").text(root)
    return f"{root}/document=*.json"


@registered(
    O.query(
        "SELECT \"Key\", text, goldresp, problemsize, array_to_string(expectedresp, '|') AS expectedresp "
        'FROM trials WHERE "Key" % 10 <> 3'
    )
)
def documents_but_corrupt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A malformed record costs itself, not its document."""
    rows = records.read_json(spark, _damaged_documents(spark, sf_dir), _DOCUMENT, skip_corrupt=True)
    return rows.withColumn("expectedresp", F.array_join("expectedresp", "|"))


@registered(O.query('SELECT count(*) AS n_records, count(*) FILTER ("Key" % 10 = 3) AS n_corrupt FROM trials'))
def corrupt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of documents are left out, over all documents."""
    counted = eg.corrupt_documents(spark, _damaged_documents(spark, sf_dir), _DOCUMENT)
    return counted.agg(F.sum("n_records").alias("n_records"), F.sum("n_corrupt").alias("n_corrupt"))


@registered(_DOCUMENT_SQL)
def zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of many members through the reader, which deals the members out."""
    root = scratch_path(spark, "archives")
    names = [f.name for f in _DOCUMENT.fields]
    rows = D.trials(spark, sf_dir).select(F.to_json(F.struct(*names)).alias("value"))
    packed = rows.repartition(4).mapInPandas(pieces.archives_in(root, lines=200), "path string")
    paths = [r.path for r in packed.collect()]  # one for each archive
    return records.read_json(spark, paths, _DOCUMENT).withColumn("expectedresp", F.array_join("expectedresp", "|"))


@registered(_DOCUMENT_SQL)
def json_lists_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_documents(spark, _documents(spark, sf_dir, ".json.gz", "gzip"))


@registered(_DOCUMENT_SQL)
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are objects of columns, through the reader."""
    return _read_documents(spark, _documents(spark, sf_dir, ".json", "none", columns=True))


@registered(
    """WITH lines AS (
  SELECT role, string_split(text, chr(10)) AS said FROM conversations
)
SELECT (i - 1)::INTEGER AS position, role, said[i] AS content, said[-1] AS target_message
FROM lines, unnest(range(1, len(said))) AS u(i)"""
)
def trainset_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training dialogs, nested on file, flattened on reading.

    The lines of each turn are taken as messages, the last one as the answer to learn.
    """
    turns = D.table(spark, sf_dir, "conversations").select("role", F.split("text", "\n").alias("said"))
    before = F.slice("said", F.lit(1), F.array_size("said") - 1)
    messages = F.transform(before, lambda m: F.struct(F.col("role"), m.alias("content")))
    dialogs = turns.select(
        F.struct(messages.alias("messages")).alias("dialog_history"),
        F.element_at("said", -1).alias("target_message"),
    )
    path = f"{scratch_path(spark, 'training_set')}/trials.jsonl.bz2"
    dialogs.write.option("compression", "bzip2").json(path)
    return eg.flatten_dialogs(eg.load_trainset(spark, path))


@registered(
    O.query(
        """SELECT "Key", (SELECT count(*)::VARCHAR FROM region) AS PARAM_size,
  '''' || (SELECT min(r_name) FROM region) || '''' AS PARAM_name, 'None' AS PARAM_none,
  'True' AS PARAM_flag FROM trials"""
    )
)
def params_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of an experiment's specification as constant columns of its trials."""
    params = F.struct(
        F.count(F.lit(1)).alias("size"), F.min("r_name").alias("name"),
        F.lit(None).cast("string").alias("none"), F.lit(True).alias("flag"),
    )
    spec = F.struct(
        F.lit("e").alias("experimentname"), F.lit("s").alias("summary"), F.lit(1).alias("seed"),
        F.array(params).alias("params"),
    )
    text = D.table(spark, sf_dir, "region").agg(
        F.to_json(spec, {"ignoreNullFields": "false"}).alias("spec")
    ).first()[0]
    read = trial_files.parse_experiment_specs(text)[3]
    return trial_files.add_params_fields(D.trials(spark, sf_dir).select("Key"), read)


@registered(
    O.query(
        "SELECT EXPNAME, count(*) AS n, min(EXP_i) AS first_i, max(EXP_i) AS last_i, "
        "sum(problemsize)::BIGINT AS sizes FROM twice GROUP BY EXPNAME",
        """twice AS (
  SELECT 'new' AS EXPNAME, row_number() OVER (ORDER BY "Key") - 1 AS EXP_i, problemsize FROM trials
  UNION ALL
  SELECT 'old', row_number() OVER (ORDER BY "Key") - 1, problemsize FROM older_trials
)""",
    )
)
def union_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of two experiments in one scan, each with its own name and row numbers."""
    root = scratch_path(spark, "experiments")
    for name, rows in (("new", D.trials(spark, sf_dir)), ("old", D.older_trials(spark, sf_dir))):
        eg.obfuscate_goldresp(rows).write.json(f"{root}/{name}/trials.jsonl")
    both = eg.load_all_trials(spark, [f"{root}/new", f"{root}/old"], extra=NO_EXTRA)
    return both.groupBy("EXPNAME").agg(
        F.count(F.lit(1)).alias("n"), F.min("EXP_i").alias("first_i"),
        F.max("EXP_i").alias("last_i"), F.sum("problemsize").alias("sizes"),
    )


@registered(
    O.query(
        f'SELECT prompting, modelname, {_heads(_cell("mean", "sem", 100))} FROM st '
        "GROUP BY prompting, modelname",
        *_stats_ctes("acc", _PROBLEM),
    )
)
def analysis_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a test set folder to the accuracy table."""
    path = _stored_trials(spark, sf_dir, "jsonl.bz2", "bzip2")
    folder = path.rpartition("/")[0]
    _stored_results(spark, sf_dir, f"{folder}/results")
    return eg.analyse_results_in_testset_dir(spark, folder).accuracy


# --- responses and coverage ---------------------------------------------------------------


def _positional(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as trials in the order of their keys, and responses to the first part."""
    orders = D.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))
    trials = orders.select(
        F.col("o_orderkey").alias("EXP_i"), text.alias("text"), F.col("o_orderpriority").alias("skin")
    )
    n_answered = D.table(spark, sf_dir, "lineitem").agg(F.expr("count(*) div 8")).scalar()
    answered = eg.first_rows(orders, n_answered, "o_orderkey")
    results = answered.select(
        F.col("o_orderkey").alias("EXP_i"), text.alias("text2"), F.col("o_orderstatus").alias("resp")
    )
    return trials, results


@registered(
    "SELECT o_orderkey AS EXP_i, 'Q' || o_orderkey AS text, o_orderpriority AS skin, "
    "o_orderstatus AS resp FROM orders WHERE o_orderkey < (SELECT count(*) // 8 FROM lineitem)"
)
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials, results = _positional(spark, sf_dir)
    return eg.require_same_text(eg.join_by_position(trials, results))


@registered(
    "SELECT o_orderkey AS EXP_i, 'Q' || o_orderkey AS text, 'Q' || (o_orderkey + 1) AS text2 "
    "FROM orders WHERE o_orderkey % 11 = 3"
)
def text_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _positional(spark, sf_dir)[0]
    results = trials.select("EXP_i", F.col("text").alias("text2"))
    i = F.col("EXP_i")
    shifted = F.when(i % 11 == 3, F.concat(F.lit("Q"), (i + 1).cast("string"))).otherwise(F.col("text2"))
    joined = eg.join_by_position(trials, results.withColumn("text2", shifted))
    return eg.text_mismatches(joined).select("EXP_i", "text", "text2")


@registered(
    "SELECT o_orderkey AS EXP_i, 'Q' || o_orderkey AS text, CASE WHEN o_orderkey % 11 = 3 THEN 'Q' || (o_orderkey + 1) END AS text2 "
    "FROM orders WHERE o_orderkey % 11 = 3 OR o_orderkey % 13 = 5"
)
def mismatches_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing and missing questions, found by their digests."""
    trials = _positional(spark, sf_dir)[0]
    i = F.col("EXP_i")
    shifted = F.when(i % 11 == 3, F.concat(F.lit("Q"), (i + 1).cast("string"))).when(i % 13 != 5, F.col("text"))
    return eg.mismatches_by_position(trials, trials.select("EXP_i", shifted.alias("text2")))


@registered(
    "SELECT o_orderkey AS prefix_key, o_totalprice FROM orders "
    "WHERE o_orderkey < (SELECT count(*) // 8 FROM lineitem)"
)
def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of one table, as many as another one calls for."""
    n = D.table(spark, sf_dir, "lineitem").agg(F.expr("count(*) div 8")).scalar()
    rows = eg.first_rows(D.table(spark, sf_dir, "orders"), n, "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("prefix_key"), "o_totalprice")


# Rows of a packed file of responses.
_PACKED_ROWS = 250_000


@registered(
    O.query(
        """SELECT EXPNAME, modelname, count(*) AS n, sum(EXP_i)::BIGINT AS rows_sum,
  count(*) FILTER (resp = goldresp) AS n_right, count(confidence) AS n_confidence
FROM (
  SELECT 'one' AS EXPNAME, r.modelname, t.EXP_i, t.goldresp, r.resp, CASE WHEN t."Key" % 2 = 0 THEN 0.5 END AS confidence
  FROM numbered t JOIN results r ON r."Key" = t."Key"
  UNION ALL
  SELECT 'two', r.modelname, t.EXP_i, t.goldresp, r.resp, CASE WHEN t."Key" % 2 = 0 THEN 0.5 END
  FROM numbered t JOIN results r ON r."Key" = t."Key"
  WHERE t.tuple_ID < (SELECT count(*) // 2 FROM orders)
) GROUP BY EXPNAME, modelname""",
        'numbered AS (SELECT *, row_number() OVER (ORDER BY "Key") - 1 AS EXP_i FROM trials)',
    )
)
def responses_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments answered by position, the second one only in part."""
    root = scratch_path(spark, "experiments")
    trials = D.trials(spark, sf_dir, D.ordered_orders(spark, sf_dir)).sortWithinPartitions("Key")
    stored = eg.obfuscate_goldresp(trials)
    half = D.table(spark, sf_dir, "orders").agg(F.expr("count(*) div 2")).scalar()
    answers = D.results(spark, sf_dir)
    # one join for all models, whose files are then written from its rows
    for name, ending in (("one", ".jsonl"), ("two", ".jsonl.partial")):
        stored.write.option("compression", "gzip").json(f"{root}/{name}/trials.jsonl")
        rows = eg.load_trials_as_dataframe(spark, f"{root}/{name}/trials.jsonl", extra=NO_EXTRA)
        if name == "two":
            rows = eg.first_rows(rows, half, "tuple_ID")
        confidence = F.when(F.col("Key") % 2 == 0, F.lit(0.5)).alias("confidence")
        joined = eg.assemble_trials_and_results_df(rows.select("Key", "EXP_i", "text"), answers)
        answered = materialise(joined.select(
            "modelname", F.col("EXP_i").alias("row_i"), F.col("text").alias("text2"), "resp", confidence
        ), "answered")
        for model in D.MODELS:
            mine = answered.where(F.col("modelname") == model).drop("modelname").write
            # a packed file is read by one task
            mine.option("compression", "gzip").option("maxRecordsPerFile", _PACKED_ROWS).json(f"{root}/{name}/results/{model}{K.LEGACY_ENDING}{ending}")
    both = eg.load_all_results(spark, [root], include_partials=True)
    right = F.count_if(F.col("resp") == F.col("goldresp"))
    return both.groupBy("EXPNAME", "modelname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("EXP_i").alias("rows_sum"),
        right.alias("n_right"), F.count("confidence").alias("n_confidence"),
    )


@registered(
    O.query(
        """SELECT m.modelname, t."Key", t.text FROM trials t, (SELECT DISTINCT modelname FROM results) m
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r."Key" = t."Key" AND r.modelname = m.modelname)"""
    )
)
def pending_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model has still to answer."""
    trials, results = D.trials(spark, sf_dir), D.results(spark, sf_dir)
    left = []
    for model in D.MODELS:
        pending = eg.pending_trials(trials, results.where(F.col("modelname") == model))
        left.append(pending.select(F.lit(model).alias("modelname"), "Key", "text"))
    return eg.stack(left)


@registered(
    O.query(
        """SELECT m.modelname, m.prompting, t."Key", t.text FROM trials t, (SELECT DISTINCT modelname, prompting FROM results
  UNION ALL SELECT 'silent-model', 'basic') AS m
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r."Key" = t."Key" AND r.modelname = m.modelname AND r.prompting = m.prompting)"""
    )
)
def pending_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every model has still to answer, one of them all of it, from one scan of the responses."""
    models = [(m, D.PROMPTING) for m in (*D.MODELS, "silent-model")]
    pending = eg.pending_by_model(D.trials(spark, sf_dir), D.results(spark, sf_dir), models)
    return pending.select("modelname", "prompting", "Key", "text")


@registered(
    O.query(
        """SELECT modelname, prompting, count(*) AS n_results, (SELECT count(*) FROM trials) AS n_trials,
  count(*) <> (SELECT count(*) FROM trials) AS is_partial FROM results GROUP BY modelname, prompting"""
    )
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.coverage(D.trials(spark, sf_dir), D.results(spark, sf_dir))


@registered(
    O.query(
        'SELECT "Key", modelname, resp FROM assembled '
        "WHERE resp <> '' AND NOT list_contains(expectedresp, resp)"
    )
)
def invalid_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.invalid_responses(assembled(spark, sf_dir)).select("Key", "modelname", "resp")


@registered(
    O.query(
        'SELECT "Key", modelname, resp FROM assembled '
        "WHERE resp = '' OR list_contains(expectedresp, resp)"
    )
)
def checked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict check passes once invalid responses are turned into missing ones."""
    rows = assembled(spark, sf_dir).where(F.col("resp") != "MAYBE")
    return eg.require_valid_responses(rows).select("Key", "modelname", "resp")


@registered(
    O.query(
        f"""SELECT "Key", modelname,
  text || chr(10) || '{K.REPROMPT}[' || array_to_string(expectedresp, ', ') || ']' AS text
FROM assembled WHERE resp <> '' AND NOT list_contains(expectedresp, resp)"""
    )
)
def reprompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.reprompts(assembled(spark, sf_dir)).select("Key", "modelname", "text")


@registered(
    O.query(
        """SELECT "Key", expectedresp[length(text) % len(expectedresp) + 1] AS resp
FROM trials"""
    )
)
def batch_responder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function asked every question; it picks an answer by the question's length."""

    def by_length(question: str, accepted: list[str]) -> str:
        return accepted[len(question) % len(accepted)]

    return eg.respond(D.trials(spark, sf_dir), by_length)


def _drawn_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 15))::BIGINT"


_RANDOM = f"""random_answers AS (
  SELECT "Key", CASE WHEN {_drawn_sql('"Key"', f"'{K.RESPONDER_SEED}'", "'silent'")} % 1000 < {K.NO_RESPONSE_PER_MILLE} THEN ''
    ELSE expectedresp[{_drawn_sql('"Key"', f"'{K.RESPONDER_SEED}'", "'choice'")} % len(expectedresp) + 1] END AS resp FROM trials
)"""


@registered(O.query('SELECT "Key", resp FROM random_answers', _RANDOM))
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.random_responses(D.trials(spark, sf_dir))


@registered(
    O.query(
        """SELECT problemname, round(sum(weight * hit) / count(DISTINCT tuple_ID), 6) AS acc,
  round(sum(weight * lean) / count(DISTINCT tuple_ID), 6) AS bias, count(DISTINCT tuple_ID) AS n
FROM (
  SELECT t.problemname, t.tuple_ID, CASE WHEN goldresp IN ('1', '2') THEN 0.25 ELSE 0.5 END::DOUBLE AS weight,
    (CASE WHEN resp IN ('1', '2') THEN '1' ELSE resp END = CASE WHEN goldresp IN ('1', '2') THEN '1' ELSE goldresp END)::INTEGER AS hit,
    CASE WHEN resp IN ('TRUE', 'POSSIBLE', '1', '2') THEN 1 WHEN resp = '' THEN 0 ELSE -1 END AS lean
  FROM trials t JOIN random_answers r ON r."Key" = t."Key"
) GROUP BY problemname""",
        _RANDOM,
    )
)
def random_baseline_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy, one half, and mean bias, 0, 0 or a third, of random answers over the tuples of a problem."""
    trials = D.trials(spark, sf_dir)
    answers = eg.random_responses(trials).withColumns({
        "modelname": F.lit("random"), "prompting": F.lit(D.PROMPTING),
    })
    scores = eg.compute_acc_table(eg.assemble_trials_and_results_df(trials, answers), carry=["problemname"])
    return rounded(scores.groupBy("problemname").agg(
        F.avg("acc").alias("acc"), F.avg("bias").alias("bias"), F.count(F.lit(1)).alias("n")
    ))


@registered()
def random_baseline_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close to one half for every problem."""
    trials = D.trials(spark, sf_dir)
    answers = eg.random_responses(trials).withColumns({
        "modelname": F.lit("random"), "prompting": F.lit(D.PROMPTING),
    })
    scores = eg.compute_acc_table(
        eg.assemble_trials_and_results_df(trials, answers), carry=_SIZE
    )
    return eg.accuracy_by_group(scores, ("modelname", "problemname"))


@registered(
    O.query(
        "SELECT modelname, count(*) AS n, sum(tuple_ID)::BIGINT AS tuple_sum "
        "FROM assembled GROUP BY modelname"
    )
)
def incremental_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results files taken in as two arrivals, and the assembled table they leave."""
    root = scratch_path(spark, "arrivals")
    trials, rows = D.trials(spark, sf_dir), D.results(spark, sf_dir)
    for arrived in (D.MODELS[:1], D.MODELS[1:]):
        for model in arrived:
            mine = rows.where(F.col("modelname") == model)
            eg.write_results(mine, f"{root}/results", D.PROMPTING, model)
        incremental.ingest_new_results(
            spark, trials, f"{root}/results/*{K.RESULTS_ENDING}", f"{root}/table", f"{root}/state"
        ).awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("modelname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tuple_ID").alias("tuple_sum")
    )


# Orders whose lines are in one of the files that grow.
_GROWING_ORDERS = 200_000


def _grown(folder: str, whole: bool):
    """For ``mapInPandas``: a task writes lines of one model to a file in its own folder; if not ``whole``, the first batch less a few letters."""

    def write(batches):
        first = next(batches, None)
        if first is None or first.empty:
            return
        path = f"{folder}/{TaskContext.get().partitionId():05d}/{D.PROMPTING}___{first['modelname'][0]}{K.RESULTS_ENDING}"
        system, inside = pieces.file_system(path)
        system.create_dir(inside.rpartition("/")[0])
        with system.open_output_stream(inside) as raw:
            text = "".join(f"{x}\n" for x in first["value"])
            raw.write(text.encode() if whole else text[:-5].encode())
            for batch in batches if whole else ():
                raw.write("".join(f"{x}\n" for x in batch["value"]).encode())
        yield pd.DataFrame({"path": [path]})

    return write


@registered(
    O.query(
        'SELECT modelname, count(*) AS n, count(DISTINCT "Key") AS n_keys, sum(tuple_ID)::BIGINT AS tuple_sum, '
        "count(*) FILTER (resp = goldresp) AS n_right FROM assembled GROUP BY modelname"
    )
)
def growing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results files that are taken in half-written, with a last line cut off, and again when they are whole."""
    root = scratch_path(spark, "growing")
    trials, line = D.trials(spark, sf_dir), F.to_json(F.struct("Key", "resp")).alias("value")
    rows = D.results(spark, sf_dir).select("Key", "modelname", line)
    # a key's hash picks its file, so that a file grows by the lines it had and more
    n_files = D.n_tasks(spark, sf_dir, _GROWING_ORDERS)
    for whole in (False, True):
        for model in D.MODELS:
            mine = rows.where(F.col("modelname") == model).repartition(n_files, "Key").sortWithinPartitions("Key", "value")
            mine.mapInPandas(_grown(f"{root}/results", whole), "path string").collect()
        growing.ingest_growing_results(spark, trials, f"{root}/results", f"{root}/table", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("modelname").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Key").alias("n_keys"), F.sum("tuple_ID").alias("tuple_sum"),
        F.count_if(F.col("resp") == F.col("goldresp")).alias("n_right"),
    )


# --- profiles, comparison, order -------------------------------------------------------------


def _profile_sql() -> str:
    """SQL of the profile of the documents with the labels some of them have."""
    fields = {
        "doc_id": "bigint", "lang": "string", "quality": "int", "toxic": "int", "ratio": "double",
    }
    parts = []
    for field, declared in fields.items():
        values, gaps = f"count({field})", f"count(*) - count({field})"
        by_type = {t: "NULL::BIGINT" for t in ("bigint", "double", "int", "string")}
        by_type |= {declared: f"nullif({values}, 0)", "void": f"nullif({gaps}, 0)"}
        types = ", ".join(f'{n} AS "{t}"' for t, n in by_type.items())
        parts.append(
            f"SELECT '{field}' AS field, '{declared}' AS dtype, count(*) AS size, "
            f"{values} AS count, {gaps} AS isna, {types} FROM sparse"
        )
    return (
        "WITH sparse AS (SELECT d.doc_id, lang, quality, toxic, quality / n_chars::DOUBLE AS ratio "
        "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)\n" + "\nUNION ALL ".join(parts)
    )


@registered(_profile_sql())
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the labels some of them have."""
    documents, given = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels")
    sparse = documents.join(given, "doc_id", "left").select(
        "doc_id", "lang", "quality", "toxic", (F.col("quality") / F.col("n_chars")).alias("ratio")
    )
    return eg.datatype_counts(sparse)


@registered(
    """WITH mixed AS (
  SELECT CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '"x"'
              WHEN 3 THEN 'not json' END AS props, event_id % 5 AS kind FROM events
)
SELECT 'props' AS field, 'string' AS dtype, count(*) AS size, count(props) AS count,
       count(*) - count(props) AS isna, nullif(count(*) FILTER (kind = 1), 0) AS "array",
       NULL::BIGINT AS "bigint", NULL::BIGINT AS "boolean", NULL::BIGINT AS "decimal",
       NULL::BIGINT AS "double", nullif(count(*) FILTER (kind = 0), 0) AS "object",
       nullif(count(*) FILTER (kind IN (2, 3)), 0) AS "string",
       nullif(count(*) FILTER (kind = 4), 0) AS "void"
FROM mixed"""
)
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts counted by the kind of value they hold."""
    kind = F.col("event_id") % 5
    mixed = (
        F.when(kind == 0, F.col("props")).when(kind == 1, F.lit("[1, 2]"))
        .when(kind == 2, F.lit('"x"')).when(kind == 3, F.lit("not json"))
    )
    events = D.table(spark, sf_dir, "events").select(mixed.alias("props"))
    return eg.datatype_counts(events, json_fields=["props"])


def _altered_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = D.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    altered = (
        orders.withColumn("o_totalprice", price)
        .withColumn("o_custkey", F.col("o_custkey").cast("string"))
        .withColumn("o_clerk", F.lit("c"))
        .drop("o_orderpriority")
    )
    # the first table is the longer one
    further = D.table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"))
    orders = orders.unionByName(further.withColumn("o_orderkey", F.col("o_orderkey").cast(orders.schema["o_orderkey"].dataType)), allowMissingColumns=True)
    return orders, altered


_N2 = "(SELECT count(*) FROM b)"


@registered(
    f"""WITH b AS (SELECT * FROM orders)
SELECT field, found_in, (SELECT count(*) + (SELECT count(*) FROM customer) FROM orders) AS rows_1, {_N2} AS rows_2, {_N2} AS n_compared,
       n_differing::BIGINT AS n_differing, same
FROM (VALUES
  ('o_orderkey', 'both', 0, true), ('o_custkey', 'both', 0, false),
  ('o_orderstatus', 'both', 0, true),
  ('o_totalprice', 'both', (SELECT count(*) FROM b WHERE o_orderkey % 7 = 0), false),
  ('o_orderdate', 'both', 0, true), ('o_orderpriority', 'only_1', NULL, NULL),
  ('o_clerk', 'only_2', NULL, NULL)
) AS v(field, found_in, n_differing, same)"""
)
def compare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and further rows against a copy of the orders with some fields altered."""
    return eg.compare_dataframes(*_altered_orders(spark, sf_dir), on="o_orderkey")


@registered(
    """WITH b AS (SELECT *, CASE WHEN o_orderkey % 4001 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders)
SELECT column_name AS field, 'both' AS found_in, (SELECT count(*) FROM orders) AS rows_1, (SELECT count(*) FROM orders) AS rows_2,
  (SELECT count(*) FROM orders) AS n_compared,
  CASE column_name WHEN 'o_totalprice' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 4001 = 7) ELSE 0 END AS n_differing,
  column_name <> 'o_totalprice' OR (SELECT count(*) FROM orders WHERE o_orderkey % 4001 = 7) = 0 AS same
FROM (SELECT column_name FROM (DESCRIBE orders))"""
)
def compare_near_equal_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which few prices differ: few buckets and one field are joined."""
    orders = D.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 4001 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return eg.compare_dataframes(orders, orders.withColumn("o_totalprice", price), on="o_orderkey")


@registered(O.query(f"""SELECT "Key", tuple_ID, text, {_drawn_sql('"Key"', f"'{K.SHUFFLE_SEED}'")} AS place FROM trials"""))
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eg.shuffle_df(D.trials(spark, sf_dir).select("Key", "tuple_ID", "text"), place="place")


@registered(O.query(f"""SELECT "Key", tuple_ID, skin, {_drawn_sql('tuple_ID', f"'{K.SHUFFLE_SEED}'")} AS place FROM trials"""))
def shuffle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.trials(spark, sf_dir).select("Key", "tuple_ID", "skin")
    return eg.shuffle_df(rows, keep_groups="tuple_ID", place="place")


@registered(
    O.query(
        "SELECT (SELECT count(*) FROM trials) AS trials, (SELECT count(*) FROM results) AS results, "
        "(SELECT count(*) FROM assembled) AS assembled, (SELECT count(*) FROM acc) AS acc_table"
    )
)
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at each stage of the analysis."""
    n = F.count(F.lit(1))
    stages = {
        "results": D.results(spark, sf_dir),
        "assembled": assembled(spark, sf_dir),
        "acc_table": acc_table(spark, sf_dir),
    }
    rows = D.trials(spark, sf_dir).agg(n.alias("trials"))
    return rows.withColumns({k: df.agg(n).scalar() for k, df in stages.items()})


@registered(
    O.query(
        """SELECT modelname, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (whole = size), 0)::BIGINT AS n_kept,
  count(*) FILTER (whole = size) AS complete, count(*) FILTER (whole < size) AS incomplete,
  count(*) FILTER (whole > size) AS overfull
FROM (
  SELECT modelname, tuple_ID, len(expectedresp) AS size, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY modelname, tuple_ID) AS whole
  FROM assembled GROUP BY modelname, tuple_ID, len(expectedresp)
) GROUP BY modelname"""
    )
)
def tuple_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the completeness filter keeps and drops of each model."""
    return eg.tuple_completeness(assembled(spark, sf_dir))


@registered(
    O.query(
        f'SELECT prompting, modelname, {_heads(_cell("mean", "sem", 100))} FROM st GROUP BY prompting, modelname',
        "flat AS (SELECT * EXCLUDE (problemsize), 0 AS problemsize FROM acc)",
        *_stats_ctes("acc", _PROBLEM, source="flat"),
    )
)
def report_without_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's accuracy table for a test set whose trials have no sizes."""
    folder = scratch_path(spark, "testset")
    trials = eg.obfuscate_goldresp(D.trials(spark, sf_dir, D.spread_orders(spark, sf_dir))).drop("problemsize")
    trials.write.option("compression", "bzip2").json(f"{folder}/{K.TESTSET_FILE}")
    _stored_results(spark, sf_dir, f"{folder}/results")
    return eg.analyse_results_in_testset_dir(spark, folder).accuracy


@registered(
    O.query(
        """SELECT modelname,
  max(CASE WHEN even AND kind = 'T' THEN n END) AS "true | T", max(CASE WHEN even AND kind = 'P' THEN n END) AS "true | P",
  max(CASE WHEN even AND kind = '1' THEN n END) AS "true | 1", max(CASE WHEN NOT even AND kind = 'T' THEN n END) AS "false | T",
  max(CASE WHEN NOT even AND kind = 'P' THEN n END) AS "false | P", max(CASE WHEN NOT even AND kind = '1' THEN n END) AS "false | 1"
FROM (
  SELECT modelname, tuple_ID % 2 = 0 AS even, substr(expectedresp[1], 1, 1) AS kind, round(100.0 * count(*), 6)::DOUBLE AS n
  FROM assembled GROUP BY ALL
) GROUP BY modelname"""
    )
)
def pivot_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean and a text across: numbers of responses by both."""
    rows = assembled(spark, sf_dir).select(
        "modelname", (F.col("tuple_ID") % 2 == 0).alias("even"), F.substring(F.col("expectedresp")[0], 1, 1).alias("kind")
    )
    stats = rows.groupBy("modelname", "even", "kind").agg(F.count(F.lit(1)).cast("double").alias("mean"))
    stats = stats.withColumn("sem", F.lit(0.0))
    return rounded(eg.pivot_pretty(stats, ["even", "kind"], ["modelname"], cell_style="mean"))


@registered(O.query('SELECT "Key", tuple_ID, goldresp, modelname, prompting, resp FROM assembled'))
def loaded_and_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and results from their files, joined."""
    path = _stored_trials(spark, sf_dir, "jsonl.bz2", "bzip2")
    folder = path.rpartition("/")[0]
    _stored_results(spark, sf_dir, f"{folder}/results")
    files = [f"{folder}/results/{D.PROMPTING}___{m}{K.RESULTS_ENDING}" for m in D.MODELS]
    rows = eg.load_and_assemble_trials_and_results(spark, path, files, include_expname_fields=False)
    return rows.select("Key", "tuple_ID", "goldresp", "modelname", "prompting", "resp")


@registered(
    O.query(
        """SELECT 'random' AS modelname, count(*) AS n, count(DISTINCT r."Key") AS n_trials,
  count(*) FILTER (r.resp = t.goldresp) AS n_right, count(*) FILTER (r.resp = '') AS n_silent
FROM random_answers r JOIN trials t ON r."Key" = t."Key" GROUP BY ALL""",
        _RANDOM,
    )
)
def resumed_responder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answers a test set in two runs, the second only what the first left open."""
    path = _packed_trials(spark, sf_dir)
    folder = path.rpartition("/")[0]
    for run in range(2):
        # the first run breaks off after the trials with an even key
        reached = (lambda t: t.where(F.col("Key") % 2 == 0)) if run == 0 else None
        eg.answer_testset(spark, folder, D.PROMPTING, "random", eg.random_responses, reached)
    trials = eg.load_testset(spark, folder, extra=NO_EXTRA).select("Key", "goldresp")
    results = eg.load_results_as_dataframe(spark, f"{folder}/results/*{K.RESULTS_ENDING}")
    right = F.count_if(F.col("resp") == F.col("goldresp")).alias("n_right")
    return eg.assemble_trials_and_results_df(trials, results).groupBy("modelname").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Key").alias("n_trials"), right,
        F.count_if(F.col("resp") == "").alias("n_silent"),
    )
