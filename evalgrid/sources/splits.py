"""A stored directory of the splits of JSON-Lines files.

One read finds out, for each split of each file, how many records it holds, the number of its
first one and what fields they have. The directory is kept in the shared folder under a digest of
the files' names, sizes and times and of the settings that decide where Spark splits them, so later
reads of the same files need no other look, and a changed file makes the directory a new one.
"""

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalgrid.functions.labels import logical_file
from evalgrid.session import is_kept, keep_once

FILE, BLOCK, FIRST = "__split_file", "__block", "__first"
_POSITION = "__position"

# Splits whose directory is sent to every task; a row is a path and a few numbers. More are joined by size.
MOST_SENT = 20_000

# Settings that decide on the splits, and on which of them a task reads.
_SPLITTING = (
    "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum",
    "spark.sql.files.maxPartitionNum", "spark.sql.leafNodeDefaultParallelism",
)


def _digest(spark: SparkSession, paths: Sequence[str]) -> str:
    """What the directory depends on; the files are listed, not read."""
    files = spark.read.format("binaryFile").load(list(paths))
    told = F.struct("path", "length", "modificationTime")
    state = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64(told)), F.bit_xor(F.xxhash64(F.lit("again"), told))
    ).first()
    settings = [spark.conf.get(name, None) for name in _SPLITTING]
    return hashlib.sha256(repr([*state, settings, spark.sparkContext.defaultParallelism]).encode()).hexdigest()


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(_POSITION),
    ]


def _found(spark: SparkSession, paths: Sequence[str], fields: bool) -> DataFrame:
    lines = spark.read.text(list(paths)).where(F.btrim("value", F.lit(" \t\r")) != "").select("value", *_place())
    found = [F.min(_POSITION).alias(FIRST), F.count(F.lit(1)).alias("n")]
    if fields:
        record = F.try_parse_json("value")
        lines = lines.withColumn("record", record)
        found += [F.schema_of_variant_agg("record").alias("fields"), F.count_if(F.col("record").isNull()).alias("n_odd")]
    splits = lines.groupBy(FILE, BLOCK).agg(*found).withColumn("whole", logical_file(FILE))
    # parts of a folder by number, as names stop sorting at part 100000
    part = F.regexp_extract(FILE, r"/part-(\d+)[^/]*$", 1)
    order = [F.when(part != "", part.cast("bigint")), F.col(FILE), F.col(BLOCK)]
    in_order = Window.partitionBy("whole").orderBy(*order)
    return splits.select(
        "*",
        (F.sum("n").over(in_order) - F.col("n")).alias("before"),
        F.lead("n").over(in_order).isNull().alias("is_last"),
    )


def split_directory(spark: SparkSession, paths: Sequence[str], fields: bool = False) -> DataFrame:
    """One row per split that holds records: ``__split_file, __block, __first, n, whole, before, is_last``.

    ``before`` counts the records of the logical ``whole`` file ahead of the split, and ``is_last``
    marks the split with its last record. With ``fields`` also their names and types, as text, and
    ``n_odd`` records that are no JSON. Read once and kept until a file or a setting changes.
    """
    name = f"splits/{_digest(spark, paths)}"
    if fields or is_kept(spark, f"{name}-fields"):
        # one with fields serves those who do not ask for them, too
        found = keep_once(spark, f"{name}-fields", lambda: _found(spark, paths, True))
        return found if fields else found.drop("fields", "n_odd")
    return keep_once(spark, name, lambda: _found(spark, paths, False))


def with_position(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Add ``__row`` (the place in the logical file, from 0), ``__is_end`` (the last one there) and the directory's columns.

    ``rows`` is a scan with the columns of ``scan_places``. Each row is checked against its split, so
    a scan that was split in another way than the directory says fails, rather than be numbered wrongly.
    """
    sent = F.broadcast(directory) if directory.count() <= MOST_SENT else directory
    place = F.col(_POSITION) - F.col(FIRST)
    fits = F.coalesce(place.between(F.lit(0), F.col("n") - 1), F.lit(False))
    message = F.concat(F.lit("the files were split in another way than when their splits were counted: "), FILE)
    row = F.when(fits, F.col("before") + place).otherwise(F.raise_error(message).cast("bigint"))
    return (
        rows.join(sent, [FILE, BLOCK], "left")
        .withColumn("__row", row)
        .withColumn("__is_end", F.col("is_last") & (F.col("__row") == F.col("before") + F.col("n") - 1))
    )


def scan_places() -> list[Column]:
    """What a scan of the files has to select, beside its fields, for ``with_position``."""
    return _place()


def inferred_fields(directory: DataFrame) -> T.StructType | None:
    """The schema of the records of a directory with ``fields``, as the JSON source infers it.

    None where the source itself has to tell: a record is no JSON object, or a number may be either
    a very large whole one or a fraction. Few different texts come to the driver: the precision of
    numbers is taken off before.
    """
    if directory.where("n_odd > 0").limit(1).count():
        return None
    # fractions; whole numbers of fewer than 19 digits are no decimals but those written like 2.0
    plain = F.regexp_replace("fields", r"DECIMAL\((?:\d+, ?[1-9]\d*|(?:\d|1[0-8]), ?0)\)", "DOUBLE")
    seen = [r[0] for r in directory.select(plain).distinct().collect()]
    if not seen or not all(s.startswith("OBJECT<") and "DECIMAL(" not in s for s in seen):
        return None
    kinds = [T.DataType.fromDDL(s.replace("OBJECT<", "STRUCT<")) for s in sorted(seen)]
    return _plain(reduce(_merged, kinds)) or T.StructType([])


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merged(fields.get(f.name, T.NullType()), f.dataType)
        return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    numbers = (T.LongType, T.DoubleType)
    return T.DoubleType() if isinstance(a, numbers) and isinstance(b, numbers) else T.StringType()


def _plain(kind: T.DataType) -> T.DataType | None:
    """Types as the JSON source gives them: text for NULLs or values of several kinds, nothing for empty objects."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, _plain(f.dataType)) for f in kind.fields]
        return T.StructType([T.StructField(n, t) for n, t in fields if t is not None]) if any(t for _, t in fields) else None
    if isinstance(kind, T.ArrayType):
        element = _plain(kind.elementType)
        return T.ArrayType(element) if element is not None else None
    return T.StringType() if isinstance(kind, (T.NullType, T.VariantType)) else kind
