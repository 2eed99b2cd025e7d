"""Trials and responses derived from the ``orders`` table.

Each order becomes one tuple of two or three dependent questions; three models answer
them by a fixed arithmetic rule. Everything grows with the table, and the rules are
integer arithmetic that any SQL engine repeats exactly.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.constants import SKINS

PROBLEMS = (
    "Infer.trivial", "Infer.normal", "Consist.trivial",
    "Consist.normal", "Compl.trivial", "Compl.normal",
)
OLDER_PROBLEMS = (
    "trivial-ulist-complete-TF", "complete-TF", "trivial-complete-PI",
    "complete-PI", "incomplete-easy", "incomplete-hard",
)
ANSWERS = (("TRUE", "FALSE"), ("POSSIBLE", "IMPOSSIBLE"), ("1", "2", "3"))
SKIN_CYCLE = (*(s for skins in SKINS.values() for s in skins), "unheard-of")
MODELS = ("GPT3.5", "GPT4", "toy-model")
PROMPTING = "basic"


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))


#: Orders whose rows one task writes to files where these are slow to make.
ORDERS_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_tasks(spark: SparkSession, sf_dir: str, orders: int = ORDERS_A_TASK) -> int:
    """Tasks for all orders, so many to a task."""
    return -(-table(spark, sf_dir, "orders").count() // orders) or 1


def spread_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' keys dealt out to as many tasks as what becomes of them calls for; a scan has few, as a key takes few bytes."""
    return table(spark, sf_dir, "orders").select("o_orderkey").repartition(n_tasks(spark, sf_dir))


def ordered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' keys in as many parts, by ranges; the keys of their trials follow theirs, so these need no exchange to be in order."""
    return table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(n_tasks(spark, sf_dir), "o_orderkey")


def trials(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The trials of the table's orders, or of the ``orders`` given."""
    o, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    accepted = F.element_at(
        F.array(*(F.array(*(F.lit(a) for a in answers)) for answers in ANSWERS)),
        (F.floor(kind / 2) + 1).cast("int"),
    )
    steps = {n: F.expr(f"o_orderkey div {n}") for n in (6, 18, 54, 108)}
    tuples = (table(spark, sf_dir, "orders") if orders is None else orders).select(
        o.alias("tuple_ID"),
        accepted.alias("expectedresp"),
        _pick(PROBLEMS, kind).alias("problemname"),
        (3 + steps[6] % 3).cast("int").alias("problemsize"),
        F.concat(F.lit("Complexity_"), (steps[18] % 3).cast("string")).alias("complexity"),
        (2 + steps[54] % 2).cast("int").alias("query_len"),
        _pick(SKIN_CYCLE, steps[108] % len(SKIN_CYCLE)).alias("skin"),
    )
    i = F.col("i")
    return tuples.select(
        "*", F.explode(F.sequence(F.lit(1), F.array_size("expectedresp"))).alias("i")
    ).select(
        (F.col("tuple_ID") * 10 + i).alias("Key"),
        F.concat(F.lit("Q"), F.col("tuple_ID").cast("string"), F.lit("."), i.cast("string")).alias("text"),
        "expectedresp",
        F.element_at("expectedresp", i).alias("goldresp"),
        "problemname", "problemsize", "skin", "tuple_ID", "complexity", "query_len",
    )


def older_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials under the older names of their problems."""
    return trials(spark, sf_dir).withColumn("problemname", _pick(OLDER_PROBLEMS, F.col("tuple_ID") % 6))


def answers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """``Key, resp, modelname, prompting, expectedresp`` of all models."""
    key, m = F.col("Key"), F.col("m")
    r = ((((key % 10007) * 7919 + m * 104729) % 9973) % 100).alias("r")
    n = F.array_size("expectedresp")
    i = (key % 10).cast("int")
    resp = (
        F.when(F.col("r") == 0, F.lit(""))
        .when(F.col("r") == 1, F.lit("MAYBE"))
        .when(F.col("r") < 45 + 15 * m, F.element_at("expectedresp", i))
        .otherwise(F.element_at("expectedresp", i % n + 1))
    )
    left_out = ((m == 1) & (key % 97 == 0)) | ((m == 2) & (F.col("tuple_ID") % 5 == 0))
    return (
        trials(spark, sf_dir, orders)
        .select("Key", "tuple_ID", "expectedresp")
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(MODELS) - 1))))
        .where(~left_out)
        .select("*", r)
        .select(
            "Key",
            resp.alias("resp"),
            _pick(MODELS, m).alias("modelname"),
            F.lit(PROMPTING).alias("prompting"),
            "expectedresp",
        )
    )


def results(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    return answers(spark, sf_dir, orders).drop("expectedresp")
