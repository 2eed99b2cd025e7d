"""Responses: reading what models answered, and writing it."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid import constants as K
from evalgrid import schemas
from evalgrid.functions import labels
from evalgrid.operators.assemble import (
    answered_by_position,
    assemble_trials_and_results_df,
    stack,
    text_digest,
)
from evalgrid.operators.enrich import add_missing_columns
from evalgrid.sources.records import (
    FOLDER,
    Paths,
    as_list,
    find_files_ending_in,
    lines_but_cut_tail,
    path_exists,
)
from evalgrid.sources.splits import FILE
from evalgrid.sources.trials import (
    get_trials_file,
    is_experiment_directory,
    load_trials_as_dataframe,
)

# Endings of responses stored by position, complete and still growing.
LEGACY_FILE = K.LEGACY_ENDING + ".jsonl"
LEGACY_PARTIAL = LEGACY_FILE + ".partial"


def results_path(directory: str, prompting: str, modelname: str) -> str:
    """Where the responses of a model under a prompting are kept."""
    if "___" in prompting or "___" in modelname:
        raise ValueError("a label cannot hold three underscores in a row")
    return f"{directory.rstrip('/')}/{prompting}___{modelname}{K.RESULTS_ENDING}"


def write_results(
    responses: DataFrame, directory: str, prompting: str, modelname: str, mode: str = "errorifexists"
) -> str:
    """Write ``Key, resp`` as JSON-Lines under the standard name and return the path.

    Each task writes its part in a folder of that name; readers take it for one file.
    A missing response is kept as the empty text. ``mode`` ``append`` resumes a run.
    """
    path = results_path(directory, prompting, modelname)
    responses.select("Key", F.coalesce("resp", F.lit("")).alias("resp")).write.mode(mode).json(path)
    return path


def load_results_as_dataframe(
    spark: SparkSession,
    paths: Paths,
    add_modelname_and_prompting: bool = True,
    skip_corrupt: bool = False,
    cut_tail: bool = False,
) -> DataFrame:
    """Responses of any number of ``.jsonl`` files, in one scan.

    The labels come from the path of each row, so a filter on a label skips the other
    files. Names that carry no labels are an error, found on the list of files before any is
    read, whatever columns are asked for.

    A damaged record fails the job. ``cut_tail`` leaves it out where it is the last one of its file, as
    a crash while writing leaves it; damage at another place fails still (``damage_by_place`` counts
    both). ``skip_corrupt`` leaves out every damaged record.
    """
    paths = as_list(paths)
    if not paths:
        raise ValueError("there are no results files to read")
    for path in paths:
        if not path.rstrip("/").endswith(".jsonl"):
            raise ValueError(f"responses are read from .jsonl files only, not {path}")
    rows, path = _lines(spark, paths, schemas.RESULTS, skip_corrupt, cut_tail)
    if not add_modelname_and_prompting:
        return rows.select(*schemas.RESULTS.fieldNames())
    for name in paths:
        if not any(c in name for c in "*?[{"):
            labels.infer_modelname_and_prompting(name)
    # the scan's own list of files, which the driver has in any case
    for file in {labels.whole_file(f) for f in spark.read.text(paths).inputFiles()}:
        labels.infer_modelname_and_prompting(file)
    return labels.with_labels(rows, path).select(*schemas.RESULTS.fieldNames(), "modelname", "prompting")


def _lines(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, skip_corrupt: bool, cut_tail: bool
) -> tuple[DataFrame, str]:
    """Records of results files, and the column that has their path."""
    if cut_tail:
        if skip_corrupt:
            raise ValueError("either a cut-off tail or every damaged record is left out")
        return lines_but_cut_tail(spark, paths, schema), FILE
    mode = "DROPMALFORMED" if skip_corrupt else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(list(paths)), "_metadata.file_path"


def results_files(spark: SparkSession, directory: str) -> list[str]:
    """Paths of all results files below a folder: one per model and prompting."""
    found = find_files_ending_in(spark, directory, K.RESULTS_ENDING)
    return sorted(row.path for row in found.select("path").collect())


def load_and_assemble_trials_and_results(
    spark: SparkSession,
    trials_file: str,
    results_files: Sequence[str],
    include_expname_fields: bool = True,
    **trials_options,
) -> DataFrame:
    """Trials and the responses of all files, joined."""
    trials = load_trials_as_dataframe(
        spark, trials_file, include_expname_fields=include_expname_fields, **trials_options
    )
    return assemble_trials_and_results_df(trials, load_results_as_dataframe(spark, results_files))


# --- responses stored by position ----------------------------------------------


def load_experiment_results_as_dataframe(
    spark: SparkSession,
    paths: Paths,
    include_expname_fields: bool = True,
    include_params_fields: bool = False,
    trials_path: str | None = None,
    skip_corrupt: bool = False,
    cut_tail: bool = False,
) -> DataFrame:
    """Responses stored by position, with their trials.

    A record is ``{"row_i", "text2", "fullresp1", "fullresp2", "resp", "confidence"}``,
    later fields optional. All files are one scan and one join on experiment and row
    number. A question that differs between both sides fails the job, and so does a
    malformed record, unless ``skip_corrupt`` or, at the end of a file, ``cut_tail`` leaves it out.
    """
    paths = as_list(paths)
    records, path = _lines(spark, paths, schemas.POSITIONAL_RESULTS, skip_corrupt, cut_tail)
    records = records.select(*schemas.POSITIONAL_RESULTS.fieldNames(), F.col(path).alias("__encoded"))
    # what a path tells is worked out once for a file; the driver lists them all in any case
    told = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("__encoded"))
    told = labels.with_labels(told.distinct(), "__encoded").drop("prompting")
    # as a digest, since a path is longer than all else that crosses the exchange and is sorted there
    told = told.withColumn(FOLDER, text_digest(labels.plain_path(labels.experiment_folder_of_results("__encoded"))))
    results = records.join(F.broadcast(told), "__encoded", "left").drop("__encoded").withColumnRenamed("row_i", "EXP_i")
    if trials_path is None:
        files = [_trials_beside(spark, p) for p in paths]
    else:
        files = [trials_path]
    layouts: dict[str, set[str]] = {}
    for file in files:
        layouts.setdefault(file.rpartition("/")[2], set()).add(file)
    trials = stack(
        load_trials_as_dataframe(
            spark, sorted(group), include_params_fields=include_params_fields, keep_folder=True
        )
        for group in layouts.values()
    )
    on = [FOLDER, "EXP_i"]
    if trials_path is not None:
        trials, results, on = trials.drop(FOLDER), results.drop(FOLDER), ["EXP_i"]
    else:
        trials = trials.withColumn(FOLDER, text_digest(FOLDER))
    joined = answered_by_position(trials, results, on).drop(FOLDER)
    joined = add_missing_columns(joined, clarified=0, context_nb=0)
    return joined if include_expname_fields else joined.drop("EXPNAME", "EXP_i")


def _trials_beside(spark: SparkSession, results: str) -> str:
    folder = results.rstrip("/").rpartition("/")[0].rpartition("/")[0]
    path = get_trials_file(spark, folder)
    if path is None:
        raise FileNotFoundError(f"no trials file in {folder}, the experiment of {results}")
    return path


def load_all_results(
    spark: SparkSession,
    directories: Sequence[str],
    include_partials: bool = False,
    skip_corrupt: bool = False,
    cut_tail: bool = False,
) -> DataFrame:
    """Responses by position of all experiments in or at the given paths."""
    endings = [LEGACY_FILE] + ([LEGACY_PARTIAL] if include_partials else [])
    paths: list[str] = []
    for ending in endings:
        for directory in directories:
            if directory.endswith(ending):
                paths.append(directory)
            elif not directory.endswith((LEGACY_FILE, LEGACY_PARTIAL)):
                found = find_files_ending_in(spark, directory, ending)
                paths += sorted(row.path for row in found.select("path").collect())
    if not paths:
        raise ValueError(f"no results files in {list(directories)}")
    return load_experiment_results_as_dataframe(spark, paths, skip_corrupt=skip_corrupt, cut_tail=cut_tail)


def load_as_dataframe(
    spark: SparkSession,
    path: str,
    include_expname_fields: bool = True,
    include_params_fields: bool = False,
) -> DataFrame:
    """Trials of an experiment folder or trials file, or trials with positional responses."""
    options = {
        "include_expname_fields": include_expname_fields,
        "include_params_fields": include_params_fields,
    }
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such file or folder: {path}")
    name = path.rstrip("/").rpartition("/")[2]
    if name.startswith("trials."):
        return load_trials_as_dataframe(spark, path, **options)
    if name.endswith((LEGACY_FILE, LEGACY_PARTIAL)):
        return load_experiment_results_as_dataframe(spark, path, **options)
    if is_experiment_directory(spark, path):
        return load_trials_as_dataframe(spark, get_trials_file(spark, path), **options)
    raise ValueError(
        f"{path} is neither an experiment folder, a trials file nor a file ending in {LEGACY_FILE}"
    )
