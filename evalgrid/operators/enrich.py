"""Derived trial columns. Every function is a projection, usable with ``transform``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid import constants as K
from evalgrid.functions import lookups as L


def deobfuscate_goldresp(df: DataFrame) -> DataFrame:
    """Turn the hidden gold answer ``goldresp_obfusc`` into a readable ``goldresp``."""
    if "goldresp_obfusc" not in df.columns:
        raise ValueError("there is no column goldresp_obfusc")
    shown = {hidden: gold for gold, hidden in K.GOLD_TO_HIDDEN.items()}
    return df.withColumn("goldresp_obfusc", L.replaced("goldresp_obfusc", shown)).withColumnRenamed(
        "goldresp_obfusc", "goldresp"
    )


def obfuscate_goldresp(df: DataFrame) -> DataFrame:
    """Hide ``goldresp`` as ``goldresp_obfusc``, the form kept on disk."""
    if "goldresp" not in df.columns:
        raise ValueError("there is no column goldresp")
    return df.withColumn("goldresp", L.replaced("goldresp", K.GOLD_TO_HIDDEN)).withColumnRenamed(
        "goldresp", "goldresp_obfusc"
    )


def add_bintern_and_globcomplex_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "bintern": L.arity_name("query_len"),
        "globcomplex": L.global_complexity("complexity", "query_len"),
    })


def add_problem_categorization_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_control_experiment": L.is_control("problemname"),
        "problem_category": L.lookup("problemname", K.PROBLEM_CATEGORY),
        "problem_normaltrivial": L.lookup("problemname", K.PROBLEM_DIFFICULTY),
    })


def add_skin_categorization_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "domain": L.lookup("skin", K.SKIN_DOMAIN),
        "intraining": L.lookup("skin", K.SKIN_TRAINING),
    })


def add_fields_for_finegrained_analysis(df: DataFrame) -> DataFrame:
    """All derived fields above."""
    return (
        df.transform(add_bintern_and_globcomplex_fields)
        .transform(add_problem_categorization_fields)
        .transform(add_skin_categorization_fields)
    )


def add_missing_columns(df: DataFrame, **values) -> DataFrame:
    """Add each named column with its constant, unless it is there already."""
    absent = {name: F.lit(v) for name, v in values.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df
