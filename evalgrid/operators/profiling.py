"""Describing one table, and comparing two."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.lookups import named
from evalgrid.session import materialise

# Kinds of value a JSON text can hold, by the prefix of its schema.
_JSON_KINDS = {
    "object": "OBJECT",
    "array": "ARRAY",
    "string": "STRING",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "decimal": "DECIMAL",
    "boolean": "BOOLEAN",
    "void": "VOID",
}


def _with_json_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Add, under the given names, the kind of value in each JSON text.

    Text that is no JSON is a plain string. The schema of a text is a column of its own,
    so that a text is parsed once however many kinds it is compared with.
    """
    schemas = {f"__schema_{k}": F.schema_of_variant(F.try_parse_json(named(c))) for c, k in kinds.items()}
    df = df.select("*", *(s.alias(n) for n, s in schemas.items()))
    found = {}
    for c, k in kinds.items():
        kind = F.lit("string")
        for name, prefix in _JSON_KINDS.items():
            kind = F.when(F.col(f"__schema_{k}").startswith(prefix), F.lit(name)).otherwise(kind)
        found[k] = F.when(named(c).isNotNull(), kind).otherwise(F.lit("void"))
    return df.select("*", *(kind.alias(k) for k, kind in found.items()))


def datatype_counts(df: DataFrame, json_fields: Sequence[str] = ()) -> DataFrame:
    """One row per column: its type, its rows, values and NULLs, and values per type.

    The type of a column fixes the type of its values; texts in ``json_fields`` are
    counted by the kind of value they hold. NULL counts as type ``void``. One pass.
    """
    declared = dict(df.dtypes)
    names = list(declared)
    kinds = {n: list(_JSON_KINDS) if n in json_fields else [declared[n], "void"] for n in names}
    all_kinds = sorted({k for n in names for k in kinds[n]})
    kind_of = {n: f"__kind{i}" for i, n in enumerate(names) if n in json_fields}
    figures = [F.count(F.lit(1)).alias("size")]
    for i, n in enumerate(names):
        figures.append(F.count(named(n)).alias(f"n{i}"))
        if n in json_fields:
            figures += [
                F.count_if(F.col(kind_of[n]) == k).alias(f"n{i}_{k}") for k in kinds[n]
            ]
    rows = []
    for i, n in enumerate(names):
        values, size = F.col(f"n{i}"), F.col("size")
        by_kind = {declared[n]: values, "void": size - values}
        if n in json_fields:
            by_kind = {k: F.nullif(F.col(f"n{i}_{k}"), F.lit(0)) for k in kinds[n]}
        else:
            by_kind = {k: F.nullif(v, F.lit(0)) for k, v in by_kind.items()}
        rows.append(F.struct(
            F.lit(n).alias("field"),
            F.lit(declared[n]).alias("dtype"),
            size.alias("size"),
            values.alias("count"),
            (size - values).alias("isna"),
            *(by_kind.get(k, F.lit(None)).cast("bigint").alias(k) for k in all_kinds),
        ))
    return _with_json_kinds(df, kind_of).agg(*figures).select(F.inline(F.array(*rows)))


def field_sets(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """Where each field occurs: in both tables, only in the first or only in the second."""
    first, second = dict(df1.dtypes), dict(df2.dtypes)
    rows = [
        (f, "both" if f in first and f in second else "only_1" if f in first else "only_2",
         first.get(f), second.get(f))
        for f in [*first, *(f for f in second if f not in first)]
    ]
    return df1.sparkSession.createDataFrame(
        rows, "field string, found_in string, dtype_1 string, dtype_2 string"
    )


# Buckets of row numbers whose checksums are compared first; so many rows are sent to every task at most.
BUCKETS = 8192


def _bucket(on: Sequence[str], buckets: int) -> Column:
    """The bucket of a row number; NULL for rows without one."""
    known = [named(c).isNotNull() for c in on]
    return F.when(reduce(lambda a, b: a & b, known), F.pmod(F.xxhash64(*map(named, on)), F.lit(buckets)))


def _checksums(df: DataFrame, on: Sequence[str], values: Sequence[Column], buckets: int) -> DataFrame:
    """One row per bucket: its rows, and 128 bits over the row numbers (``c0``) and each of the values together with them.

    An exclusive or of the rows' hashes, so it combines before the exchange and does not depend on
    the order of rows.
    """
    keys = [named(c) for c in on]

    def sums(i: int, *value: Column) -> list[Column]:
        return [
            F.bit_xor(F.xxhash64(*keys, *value)).alias(f"c{i}"),
            F.bit_xor(F.xxhash64(F.lit(i), *value, *keys)).alias(f"e{i}"),
        ]

    figures = [s for i, v in enumerate([None, *values]) for s in sums(i, *([] if v is None else [v]))]
    return df.groupBy(_bucket(on, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *figures)


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def compare_dataframes(
    df1: DataFrame, df2: DataFrame, on: Sequence[str] | str, buckets: int = BUCKETS
) -> DataFrame:
    """Compare two tables field by field over the rows that share the row number ``on``.

    One row per field: where it occurs, the rows of both tables, the rows compared
    and, for a common field, how many of them differ (two NULLs do not). Row numbers
    that repeat in a table are an error, as it would be open which rows to compare.

    Checksums of each bucket of row numbers and each field are compared first, for which nothing but
    a row per bucket is exchanged. Rows are joined in the buckets that differ alone, and with those
    fields alone that differ in any; equal tables are not joined at all.
    """
    on = [on] if isinstance(on, str) else list(on)
    first, second = dict(df1.dtypes), dict(df2.dtypes)
    common = [f for f in first if f in second]
    data = [f for f in common if f not in on]
    for df in (df1, df2):
        # a look at the row numbers alone
        repeated = df.dropna(subset=on).groupBy(*on).count().where("count > 1").select(*on).first()
        if repeated is not None:
            raise ValueError(f"row number {tuple(repeated)} repeats, so it is open which rows to compare")

    # no common type to compare in, or one without equality
    as_text = {f for f in data if first[f] != second[f] or not _hashable(first[f])}
    values = [named(f).cast("string") if f in as_text else named(f) for f in data]
    numbers = F.col("rows_1"), F.col("rows_2"), F.col("n_compared")
    # numbers that are equal across types, or in two forms, would fall into different buckets
    bucketed = all(first[c] == second[c] and first[c] in ("tinyint", "smallint", "int", "bigint", "string", "date") for c in on)
    if bucketed:
        sides = [_checksums(df, on, values, buckets).alias(name) for df, name in ((df1, "x"), (df2, "y"))]
        sums = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n", "c0", "e0")]
        same = [F.col(f"x.c{i}").eqNullSafe(F.col(f"y.c{i}")) & F.col(f"x.e{i}").eqNullSafe(F.col(f"y.e{i}")) for i in range(1, len(data) + 1)]
        keyed = F.coalesce(F.col("x.bucket"), F.col("y.bucket"))
        met = materialise(sides[0].join(sides[1], F.col("x.bucket").eqNullSafe(F.col("y.bucket")), "full").select(
            keyed.alias("bucket"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"),
            (reduce(lambda a, b: a & b, sums)).alias("same_rows"), F.array(*same).alias("same_values"),
        ), "checksums")
        whole = F.col("same_rows") & F.forall("same_values", lambda s: s)
        known = F.col("bucket").isNotNull()
        # sums over the buckets come to the driver as one row
        told = met.agg(
            F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0)),
            F.coalesce(F.sum(F.when(known & whole, F.col("n1"))), F.lit(0)),
            *(F.count_if(known & ~F.col("same_values")[i]) for i in range(len(data))), F.count_if(known & ~whole),
        ).first()
        differing = [i for i in range(len(data)) if told[3 + i]]
        narrow = F.broadcast(met.where(known & ~whole).select("bucket"))  # a row per bucket at most

        def inside(df: DataFrame) -> DataFrame:
            return df.withColumn("bucket", _bucket(on, buckets)).join(narrow, "bucket", "left_semi").drop("bucket")

        if told[-1]:
            figures = _joined_figures(inside(df1), inside(df2), on, [(i, data[i], values[i]) for i in differing])
        else:
            figures = df1.sparkSession.range(1).select(F.lit(0).alias("n_compared"))
        n_compared = (F.col("n_compared") + told[2]).cast("bigint").alias("n_compared")
        rest = [F.col(f"d{i}") if i in differing and told[-1] else F.lit(0).cast("bigint").alias(f"d{i}") for i in range(len(data))]
        figures = figures.select(
            F.lit(told[0]).cast("bigint").alias("rows_1"), F.lit(told[1]).cast("bigint").alias("rows_2"), n_compared, *rest
        )
    else:
        counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((df1, "rows_1"), (df2, "rows_2"))]
        figures = _joined_figures(df1, df2, on, list(zip(range(len(data)), data, values, strict=True)))
        figures = figures.select(counts[0].scalar().alias("rows_1"), counts[1].scalar().alias("rows_2"), "*")
    rows = []
    for f in [*first, *(f for f in second if f not in first)]:
        differing_rows = F.lit(0 if f in on else None).cast("bigint")
        if f in data:
            differing_rows = F.col(f"d{data.index(f)}")
        found = "both" if f in common else "only_1" if f in first else "only_2"
        equal_types = F.lit(first.get(f) == second.get(f))
        rows.append(F.struct(
            F.lit(f).alias("field"),
            F.lit(found).alias("found_in"),
            *numbers,
            differing_rows.alias("n_differing"),
            F.when(F.lit(f in common), equal_types & (differing_rows == 0)).alias("same"),
        ))
    return figures.select(F.inline(F.array(*rows)))


def _joined_figures(
    df1: DataFrame, df2: DataFrame, on: Sequence[str], fields: Sequence[tuple[int, str, Column]]
) -> DataFrame:
    """``n_compared`` and, for each (i, field, value), ``d<i>``: the rows in which the values differ."""
    left, right = (df.select(*on, F.struct(F.lit(True), *(v.alias(f"v{i}") for i, _, v in fields)).alias(n)) for df, n in ((df1, "a"), (df2, "b")))
    differs = [F.count_if(~F.col("a")[f"v{i}"].eqNullSafe(F.col("b")[f"v{i}"])).alias(f"d{i}") for i, _, _ in fields]
    return left.join(right, list(on)).agg(F.count(F.lit(1)).alias("n_compared"), *differs)
