"""JSON in the layouts benchmark files come in."""

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid import constants as K
from evalgrid.functions.labels import (
    experiment_folder,
    experiment_name,
    logical_file,
    plain_path,
)
from evalgrid.functions.lookups import named
from evalgrid.session import scratch_path
from evalgrid.sources import pieces
from evalgrid.sources.splits import FILE, inferred_fields, scan_places, split_directory, with_position

Paths = str | Sequence[str]

# Text pieces taken from an archive are handed over in batches of about this many characters.
_BATCH_CHARS = 8_000_000
_BATCH_LINES = 20_000

PATH = "__path"
# Path of an experiment's folder.
FOLDER = "__folder"
# Position of a row in its file or document.
ROW = "__row"
_BROKEN = "__broken"
# Bytes from which a document is streamed; an eighth of it if packed.
LARGE = 1 << 29
# Objects of columns, with cells as text.
_COLUMNS = "map<string,map<string,string>>"


def as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system Spark reads has this path."""
    try:
        spark.read.text(path).schema  # noqa: B018 - resolving the path is the check
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def find_files_ending_in(spark: SparkSession, directory: str, ending: str) -> DataFrame:
    """``path, bytes`` of every file below ``directory`` whose name ends in ``ending``.

    A folder of that name written by Spark counts as one file. Contents are not read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    )
    return (
        files.select(logical_file("path").alias("path"), "length")
        .where(F.col("path").endswith(ending))
        .groupBy("path")
        .agg(F.sum("length").alias("bytes"))
    )


def _kind(path: str) -> str:
    name = path.rstrip("/")
    if name.endswith(K.JSONL_ENDINGS):
        return "lines"
    if name.endswith(K.JSON_ENDINGS):
        return "document"
    raise ValueError(f"{path}: the name has to end in one of {K.JSON_ENDINGS + K.JSONL_ENDINGS}")


def read_json(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType | None = None,
    skip_corrupt: bool = False,
    with_path: bool = False,
    large: int | None = None,
) -> DataFrame:
    """Records of JSON-Lines or JSON files, told apart by the end of their names.

    Plain, gzip, bzip2 and zip files are read; a folder of such a name written by Spark
    is read like the file. A ``.json`` document is a list of records or an object of
    columns. Without ``schema`` the files are read once more to infer it. Malformed
    records fail the job, or are left out with ``skip_corrupt`` (a crash while writing
    leaves a cut-off last record; ``corrupt_records`` counts them). ``with_path`` adds the
    path as ``__path``, for documents also the record's position as ``__row``.

    JSON-Lines, plain or bzip2, is read in splits; members of archives are dealt out to tasks; a
    document takes one task. Documents of over ``large`` bytes (``LARGE``) are streamed, which needs a schema and
    lists, and so are all documents with ``skip_corrupt``, which then costs only the records of lists that are malformed
    (``corrupt_documents`` counts them). Each document is told apart by itself, so files of both forms may be read together;
    one of neither form fails the job like a malformed record.
    """
    paths = as_list(paths)
    kinds = {(_kind(p), p.rstrip("/").endswith(".zip")) for p in paths}
    if len(kinds) != 1:
        raise ValueError("files of different layouts have to be read one by one")
    kind, zipped = kinds.pop()
    if zipped:
        texts = _archived(spark, paths, kind == "document", with_path)
        return _parse_texts(texts, kind, schema, skip_corrupt, with_path)
    if kind == "document":
        return _documents(spark, paths, schema, skip_corrupt, with_path, LARGE if large is None else large)

    reader = spark.read.option("mode", "DROPMALFORMED" if skip_corrupt else "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths)
    if with_path:
        df = df.select("*", plain_path("_metadata.file_path").alias(PATH))
    return df


def _archived(spark: SparkSession, paths: list[str], whole: bool, with_row: bool) -> DataFrame:
    """Texts in zip archives, read member by member where tasks reach the files, else from whole archives."""
    files = pieces.files_of(spark, paths)
    if all(pieces.reaches(p) for p in _schemes(files)):
        members = pieces.zip_members(files)
        texts = pieces.member_texts(members, whole)
        return texts.select(PATH, "value") if whole or not with_row else pieces.numbered_through(texts, members)
    return unzip_texts(spark.read.format("binaryFile").load(paths).select("path", "content"), whole)


def _schemes(files: DataFrame) -> list[str]:
    """One path of each file system."""
    return [r[0] for r in files.groupBy(F.substring_index("path", ":", 1)).agg(F.min("path").alias("path")).select("path").collect()]


def _documents(
    spark: SparkSession, paths: list[str], schema: T.StructType | None, skip_corrupt: bool, with_path: bool, most: int
) -> DataFrame:
    """Records of documents, each of which is a cell of a table or, if large, streamed."""
    files = pieces.files_of(spark, paths)

    def limit(path: str):
        return F.when(F.col(path).rlike(r"\.(gz|bz2)$"), most // 8).otherwise(most)

    large = files.where(F.col("length") > limit("path"))
    reached = all(pieces.reaches(p) for p in _schemes(files))
    streamed = large.limit(1).count() > 0 if not (skip_corrupt and reached and schema) else True
    texts = spark.read.text(paths, wholetext=True)
    if not streamed:
        texts = texts.select(plain_path("_metadata.file_path").alias(PATH), "value")
        return _parse_texts(texts, "document", schema, skip_corrupt, with_path)
    if not reached:
        raise ValueError(f"documents of more than {most} bytes cannot be read from this file system")
    if schema is None:
        raise ValueError(f"documents of more than {most} bytes need a schema")
    if skip_corrupt:
        # lists and objects of columns of any size are streamed, so that what is left out does not depend on it
        df = _streamed(files, schema, skip_corrupt).unionByName(_streamed_columns(files, schema))
    else:
        # the size of a file is known before it is read, so the large ones never come into a cell
        small = texts.where(F.col("_metadata.file_size") <= limit("_metadata.file_path"))
        small = small.select(plain_path("_metadata.file_path").alias(PATH), "value")
        df = _streamed(large, schema, skip_corrupt).unionByName(_parse_texts(small, "document", schema, skip_corrupt, with_path=True))
    return df if with_path else df.drop(PATH, ROW)


def _streamed(files: DataFrame, schema: T.StructType, skip_corrupt: bool) -> DataFrame:
    """Records of documents that are lists, streamed, with ``__path`` and ``__row``."""
    records = pieces.list_records(files)
    if skip_corrupt:
        parsed = F.from_json("value", _with_broken(schema), _mode(True) | {"columnNameOfCorruptRecord": _BROKEN})
        rows = records.where(pieces.WHOLE).select(parsed.alias("r"), PATH, ROW).where(~_malformed(schema))
        return rows.select(*(F.col("r")[f].alias(f) for f in schema.fieldNames()), PATH, ROW)
    message = F.concat(F.lit("neither a list of records nor an object of columns, or broken off: "), PATH)
    whole = F.when(F.col(pieces.WHOLE), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return records.where(whole).select(F.from_json("value", schema, _mode(False)).alias("r"), PATH, ROW).select("r.*", PATH, ROW)


def _streamed_columns(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of documents that are objects of columns, streamed, with ``__path`` and ``__row``; malformed ones are left out."""
    parts = pieces.column_parts(files).withColumn("columns", F.from_json("value", _COLUMNS, _mode(True)))
    # one path for each malformed document, and the driver has listed all paths
    bad = parts.where(~F.col(pieces.WHOLE) | F.col("columns").isNull()).select(PATH).distinct()
    whole = pieces.column_parts(files).join(F.broadcast(bad), PATH, "left_anti")
    return records_from_columns(whole, schema, skip_corrupt=True)


def _with_broken(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])


def _malformed(schema: T.StructType):
    """Whether the record ``r`` did not parse; every field has to be looked at for that."""
    seen = F.to_json(F.struct(*(F.col("r")[f] for f in schema.fieldNames())))
    return F.col("r")[_BROKEN].isNotNull() & seen.isNotNull()


def corrupt_documents(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """``path, n_records, n_corrupt`` of ``.json`` documents: what ``skip_corrupt`` leaves out of each.

    A list counts its records, and one more as corrupt if it breaks off; any other document counts
    as one record, corrupt if it is no object of columns. Documents of any size are looked at as a whole.
    """
    paths = as_list(paths)
    files = pieces.files_of(spark, paths)
    parsed = F.from_json("value", _with_broken(schema), _mode(True) | {"columnNameOfCorruptRecord": _BROKEN})
    lists = pieces.list_records(files).select(PATH, "value", pieces.WHOLE, parsed.alias("r"))
    lists = lists.select(PATH, (~F.col(pieces.WHOLE) | _malformed(schema)).alias("bad"), F.lit(False).alias("of_columns"))
    columns = F.from_json("value", _COLUMNS, _mode(True))
    parts = pieces.column_parts(files).select(PATH, (~F.col(pieces.WHOLE) | columns.isNull()).alias("bad"), F.lit(True).alias("of_columns"))
    # an object of columns is no list either, and counts as what it is
    found = lists.unionByName(parts).groupBy(PATH).agg(
        F.bool_or("of_columns").alias("is_object"), F.bool_or(F.col("of_columns") & F.col("bad")).alias("is_bad"),
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"),
    )
    one = F.lit(1).cast("bigint")
    return found.select(
        F.regexp_replace(PATH, "^file:/+", "file:///").alias("path"),
        F.when(F.col("is_object"), one).otherwise(F.col("n")).alias("n_records"),
        F.when(F.col("is_object"), F.col("is_bad").cast("bigint")).otherwise(F.col("n_bad")).alias("n_corrupt"),
    )


def inferred_schema(spark: SparkSession, paths: Paths) -> T.StructType:
    """Schema of JSON files; that of JSON-Lines comes from their stored directory of splits."""
    paths = as_list(paths)
    if all(is_lines(p) for p in paths):
        found = inferred_fields(split_directory(spark, paths, fields=True))
        if found is not None:
            return found
    return read_json(spark, paths).schema


def is_lines(path: str) -> bool:
    """Whether a file is JSON-Lines that Spark unpacks itself."""
    return _kind(path) == "lines" and not path.rstrip("/").endswith(".zip")


def corrupt_records(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """``path, n_records, n_corrupt`` of JSON-Lines files: what ``skip_corrupt`` leaves out of each."""
    broken = "__corrupt"
    wanted = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    lines = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken)
    # every field has to be parsed for a record to be found corrupt
    seen = F.to_json(F.struct(*map(named, schema.fieldNames())))
    rows = lines.json(as_list(paths)).select(
        logical_file("_metadata.file_path").alias("path"), (F.col(broken).isNotNull() & seen.isNotNull()).alias("bad")
    )
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("bad").alias("n_corrupt")
    )


def unzip_texts(archives: DataFrame, whole: bool = False) -> DataFrame:
    """``__path, value`` of the texts in zip archives given as ``path, content``.

    ``value`` is a line, or with ``whole`` a member. An archive is one task; its lines
    are streamed, so only the packed bytes and one batch are held.
    """

    def pieces(content: bytes) -> Iterator[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.infolist():
                if member.is_dir():
                    continue
                with archive.open(member) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8", newline="\n")
                    if whole:
                        yield text.read()
                    else:
                        yield from (line.rstrip("\r\n") for line in text)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held, chars = [], 0
                for piece in pieces(content):
                    held.append(piece)
                    chars += len(piece)
                    if chars >= _BATCH_CHARS or len(held) >= _BATCH_LINES:
                        yield pd.DataFrame({PATH: path, "value": held})
                        held, chars = [], 0
                if held:
                    yield pd.DataFrame({PATH: path, "value": held})

    return archives.select("path", "content").mapInPandas(unpack, f"{PATH} string, value string")


def _parse_texts(
    texts: DataFrame,
    kind: str,
    schema: T.StructType | None,
    skip_corrupt: bool,
    with_path: bool,
) -> DataFrame:
    """Records out of ``__path, value`` texts."""
    texts = texts.where(F.trim("value") != "")
    if kind == "lines":
        schema = schema or _inferred(texts, kind)
        mode = {"mode": "PERMISSIVE" if skip_corrupt else "FAILFAST"}
        parsed = texts.withColumn("r", F.from_json("value", schema, mode)).drop("value")
        if skip_corrupt:
            parsed = parsed.where(F.to_json("r") != "{}")
        places = [c for c in (PATH, ROW) if c in texts.columns]
        df = parsed.select("r.*", *places)
        return df if with_path else df.drop(*places)
    of_columns = F.ltrim(F.col("value")).startswith("{")
    if schema is None:
        if texts.where(of_columns).limit(1).count():
            raise ValueError("a document of columns needs a schema")
        schema = _inferred(texts, kind)
    lists = records_from_lists(texts.where(~of_columns), schema, skip_corrupt)
    columns = records_from_columns(texts.where(of_columns), schema, skip_corrupt)
    df = lists.unionByName(columns)
    return df if with_path else df.drop(PATH, ROW)


def _inferred(texts: DataFrame, kind: str) -> T.StructType:
    """Unpack once to the shared folder and let the JSON source look at all of it."""
    spark = texts.sparkSession
    path = scratch_path(spark, "unpacked")
    value = F.col("value")
    if kind == "document":
        # a text file has a record a line; JSON may have its line ends anywhere but in a string
        value = F.regexp_replace(value, "[\\r\\n]+", " ")
    texts.select(value.alias("value")).write.text(path)
    return spark.read.option("mode", "FAILFAST").json(path).schema


def _mode(skip_corrupt: bool) -> dict[str, str]:
    return {"mode": "PERMISSIVE" if skip_corrupt else "FAILFAST"}


def records_from_lists(texts: DataFrame, schema: T.StructType, skip_corrupt: bool = False) -> DataFrame:
    """Rows of documents ``[record, ...]`` given as ``__path, value``, with ``__path`` and the position ``__row``.

    A document that is no list of such records fails the job, or is left out with ``skip_corrupt``.
    """
    parsed = F.from_json("value", T.ArrayType(schema), _mode(skip_corrupt))
    is_list = F.ltrim(F.col("value")).startswith("[")
    if not skip_corrupt:
        message = F.concat(F.lit("neither a list of records nor an object of columns: "), PATH)
        parsed = F.when(is_list, parsed).otherwise(F.raise_error(message).cast(T.ArrayType(schema)))
    else:
        parsed = F.when(is_list, parsed)
    rows = texts.select(PATH, F.posexplode(parsed).alias(ROW, "r"))
    return rows.select("r.*", PATH, F.col(ROW).cast("bigint").alias(ROW))


def records_from_columns(texts: DataFrame, schema: T.StructType, skip_corrupt: bool = False) -> DataFrame:
    """Rows of documents ``{"column": {"row": value}}`` given as ``__path, value``.

    Adds ``__path`` and the row's position ``__row``. Cells are brought together per
    document and row, so a large document is spread over all tasks once it is parsed.
    A document or a cell that does not parse fails the job; with ``skip_corrupt`` the
    document is left out and the cell is NULL. Texts may be parts of documents, with the place of their first cell
    as ``__row``.
    """
    names = [f.name for f in schema.fields]
    columns = F.from_json("value", _COLUMNS, _mode(skip_corrupt))
    before = F.col(ROW) if ROW in texts.columns else F.lit(0)
    cells = (
        texts.select(PATH, before.alias("before"), F.explode(columns).alias("field", "cells"))
        .where(F.col("field").isin(names))
        .select(PATH, "field", "before", F.posexplode("cells").alias("position", "label", "cell"))
        .withColumn("position", F.col("before") + F.col("position"))
    )
    figures = [
        F.max(F.when(F.col("field") == name, F.col("cell"))).alias(name) for name in names
    ]
    position = F.min("position").cast("bigint").alias(ROW)
    # labels differ where paths begin alike, so they are compared first
    wide = cells.groupBy("label", PATH).agg(*figures, position)

    def typed(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.from_json(c, field.dataType, _mode(skip_corrupt)).alias(field.name)
        return (c.try_cast(field.dataType) if skip_corrupt else c.cast(field.dataType)).alias(field.name)

    return wide.select(*(typed(f) for f in schema.fields), PATH, ROW)


def with_row_index(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType,
    name: str = "EXP_i",
    fields: bool = False,
) -> DataFrame:
    """JSON-Lines records with their row number in the file, counted from 0.

    The number of a split's first record comes from the files' stored directory of splits, which is
    made by one look at the files and used again until they change. The experiment's ``EXPNAME`` and
    ``__folder`` are worked out once per split too.
    """
    directory = split_directory(spark, as_list(paths), fields)
    splits = (
        directory.drop("fields", "n_odd")
        .withColumn(FOLDER, experiment_folder(plain_path(FILE)))
        .withColumn("EXPNAME", experiment_name(FOLDER))
    )
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(as_list(paths)).select("*", *scan_places())
    numbered = with_position(rows, splits)
    return numbered.select(*map(named, schema.fieldNames()), F.col(ROW).alias(name), "EXPNAME", FOLDER)


def lines_but_cut_tail(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """JSON-Lines records without a damaged one that is the last of its logical file; adds the scan's ``__split_file``.

    That is what a crash while writing leaves. A damaged record at any other place fails the job.
    """
    rows = _lines_by_place(spark, paths, schema)
    message = F.concat(F.lit("damaged record before the end of "), PATH, F.lit(", row "), F.col(ROW).cast("string"))
    fails = F.raise_error(message).cast("boolean")
    whole = F.when(~F.col(_BROKEN), F.lit(True)).when(F.col("__is_end"), F.lit(False)).otherwise(fails)
    return rows.where(whole).select(*map(named, schema.fieldNames()), FILE)


def damage_by_place(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """``path, n_records, n_damaged, n_cut_off`` of JSON-Lines files.

    A damaged record is cut off if it is the last of its logical file; ``n_damaged`` counts all others.
    """
    rows = _lines_by_place(spark, paths, schema)
    end = F.col("__is_end")
    return rows.groupBy(logical_file(PATH).alias("path")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col(_BROKEN) & ~end).alias("n_damaged"),
        F.count_if(F.col(_BROKEN) & end).alias("n_cut_off"),
    )


def _lines_by_place(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """All records, damaged ones marked ``__broken``, with their path, place and whether they are the last."""
    text = "__corrupt"
    wanted = T.StructType([*schema.fields, T.StructField(text, T.StringType())])
    lines = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", text)
    # every field has to be parsed for a record to be found damaged
    seen = F.to_json(F.struct(*map(named, schema.fieldNames())))
    rows = lines.json(as_list(paths)).select("*", *scan_places())
    rows = with_position(rows, split_directory(spark, as_list(paths)))
    return rows.withColumn(_BROKEN, F.col(text).isNotNull() & seen.isNotNull()).withColumn(PATH, plain_path(FILE))
