"""Trials: the questions of a benchmark, and the records made to train on it."""

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid import constants as K
from evalgrid import schemas
from evalgrid.functions.labels import experiment_folder, experiment_name
from evalgrid.operators.assemble import stack
from evalgrid.operators.enrich import (
    add_fields_for_finegrained_analysis,
    deobfuscate_goldresp,
)
from evalgrid.sources.records import (
    FOLDER,
    PATH,
    ROW,
    Paths,
    as_list,
    inferred_schema,
    is_lines,
    path_exists,
    read_json,
    with_row_index,
)

def get_trials_file(spark: SparkSession, directory: str) -> str | None:
    """The first of the usual trials files that the folder has."""
    folder = directory.rstrip("/")
    for name in K.TRIALS_FILES:
        if path_exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    return None


def is_experiment_directory(spark: SparkSession, path: str) -> bool:
    return get_trials_file(spark, path) is not None


def infer_expname_and_expdir(spark: SparkSession, path: str) -> tuple[str, str]:
    """Name and folder of the experiment a trials file, results file or folder belongs to."""
    path = path.rstrip("/")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such file or folder: {path}")
    folder, _, name = path.rpartition("/")
    if name not in K.TRIALS_FILES:
        # results are one folder further down; a folder with trials is the experiment itself
        is_results = name.endswith(K.RESULTS_ENDING) or K.LEGACY_ENDING + "." in name
        itself = not is_results and is_experiment_directory(spark, path)
        folder = path if itself else folder.rpartition("/")[0]
    if not folder or not is_experiment_directory(spark, folder):
        raise FileNotFoundError(f"{path} belongs to no experiment folder")
    return folder.rpartition("/")[2], folder


def trials_schema(
    spark: SparkSession, paths: Paths, extra: T.StructType | None = None
) -> T.StructType:
    """Schema of trials files: the known fields they have, and every other one.

    Found by one distributed pass over the files, which is kept for later loads, unless the other
    fields are given as ``extra`` (an empty struct for none), in which case all known fields are taken.
    """
    if extra is not None:
        named = {f.name for f in extra.fields}
        return T.StructType([f for f in schemas.TRIALS.fields if f.name not in named] + extra.fields)
    known = {f.name: f for f in schemas.TRIALS.fields}
    opaque = "tuple_ID"  # any type will do as a key
    found = inferred_schema(spark, paths).fields
    return T.StructType([
        known[f.name] if f.name in known and f.name != opaque else f for f in found
    ])


def load_experiment_specs(
    spark: SparkSession, path: str
) -> tuple[str, str, int, Mapping | Sequence]:
    """``experimentname, summary, seed, params`` of a specification file.

    Such a file describes one experiment in a few lines; it is read on the driver.
    """
    if not path_exists(spark, path):
        raise ValueError(f"no such specification file: {path}")
    return parse_experiment_specs(spark.read.text(path, wholetext=True).first()[0])


def parse_experiment_specs(text: str) -> tuple[str, str, int, Mapping | Sequence]:
    spec = json.loads(text)
    return spec["experimentname"], spec["summary"], spec["seed"], spec["params"]


def add_params_fields(df: DataFrame, params: Mapping | Sequence[Mapping]) -> DataFrame:
    """Add each parameter as constant text ``PARAM_<name>``, written as Python would."""
    values = params if isinstance(params, Mapping) else params[0]
    return df.withColumns({f"PARAM_{k}": F.lit(repr(v)) for k, v in values.items()})


def load_trials_as_dataframe(
    spark: SparkSession,
    paths: Paths,
    include_expname_fields: bool = True,
    include_params_fields: bool = False,
    auto_deobfuscate: bool = True,
    extra: T.StructType | None = None,
    keep_folder: bool = False,
) -> DataFrame:
    """Trials files, with the experiment's name ``EXPNAME`` and the row number ``EXP_i``.

    Several files of one layout are one scan. See ``trials_schema`` for ``extra``. Schema and row
    numbers take one look at the files, whose findings are kept (``splits``): the first load reads
    the files twice, later ones once.
    """
    paths = as_list(paths)
    for path in paths:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"no such trials file: {path}")
    schema = trials_schema(spark, paths, extra)
    if include_expname_fields and all(map(is_lines, paths)):
        # the look for the schema has counted the splits too
        df = with_row_index(spark, paths, schema, fields=extra is None)
    else:
        by_file = include_expname_fields or keep_folder
        df = read_json(spark, paths, schema, with_path=by_file)
        if by_file:
            df = df.withColumn(FOLDER, experiment_folder(PATH))
        if include_expname_fields:
            df = _index_documents(df).withColumn("EXPNAME", experiment_name(FOLDER))
    if auto_deobfuscate and "goldresp_obfusc" in df.columns:
        df = _readable_gold(df)
    if include_params_fields:
        df = _with_params(spark, df, paths)
    df = df.drop(PATH, ROW)
    return df if keep_folder else df.drop(FOLDER)


def _index_documents(df: DataFrame) -> DataFrame:
    """Row numbers in files that are read whole, one task per file."""
    if ROW in df.columns:
        return df.withColumnRenamed(ROW, "EXP_i")
    rows = df.withColumn("__position", F.monotonically_increasing_id())
    firsts = rows.groupBy(PATH).agg(F.min("__position").alias("__first"))
    return (
        rows.join(firsts, PATH)
        .withColumn("EXP_i", F.col("__position") - F.col("__first"))
        .drop("__position", "__first")
    )


def _readable_gold(df: DataFrame) -> DataFrame:
    if "goldresp" not in df.columns:
        return deobfuscate_goldresp(df)
    # either form may be on file; the readable one fills the gaps
    shown = df.withColumnRenamed("goldresp", "__gold").transform(deobfuscate_goldresp)
    return shown.withColumn("goldresp", F.coalesce("goldresp", "__gold")).drop("__gold")


def _with_params(spark: SparkSession, df: DataFrame, paths: list[str]) -> DataFrame:
    if len(paths) != 1:
        raise ValueError("parameter fields are added one experiment at a time")
    folder = paths[0].rstrip("/").rpartition("/")[0]
    spec = f"{folder}/{folder.rpartition('/')[2]}.json"
    if not path_exists(spark, spec):
        return df
    return add_params_fields(df, load_experiment_specs(spark, spec)[3])


def load_testset(
    spark: SparkSession,
    testset_dir: str,
    add_extra_fields: bool = False,
    extra: T.StructType | None = None,
) -> DataFrame:
    """The trials of a test set folder, on request with all derived fields."""
    if not path_exists(spark, testset_dir):
        raise FileNotFoundError(f"no such test set folder: {testset_dir}")
    path = f"{testset_dir.rstrip('/')}/{K.TESTSET_FILE}"
    df = load_trials_as_dataframe(spark, path, extra=extra)
    return df.transform(add_fields_for_finegrained_analysis) if add_extra_fields else df


def load_trainset(spark: SparkSession, paths: Paths) -> DataFrame:
    """Training dialogs: nested messages and the answer to learn.

    JSON-Lines under any name, compressed or not, as the distributed files differ in it.
    """
    for path in as_list(paths):
        if not path_exists(spark, path):
            raise FileNotFoundError(f"no such training set file: {path}")
    return spark.read.schema(schemas.DIALOGS).option("mode", "FAILFAST").json(as_list(paths))


def flatten_dialogs(trainset: DataFrame) -> DataFrame:
    """One row per message of each dialog, with its position and the dialog's answer."""
    return trainset.select(
        F.posexplode("dialog_history.messages").alias("position", "message"), "target_message"
    ).select("position", "message.role", "message.content", "target_message")


def load_all_trials(
    spark: SparkSession, directories: Sequence[str], extra: T.StructType | None = None
) -> DataFrame:
    """Trials of several experiments; files of one layout are read in one scan."""
    layouts: dict[str, list[str]] = {}
    for directory in directories:
        path = get_trials_file(spark, directory)
        if path is None:
            raise FileNotFoundError(f"no trials file in {directory}")
        layouts.setdefault(path.rpartition("/")[2], []).append(path)
    return stack(load_trials_as_dataframe(spark, p, extra=extra) for p in layouts.values())
