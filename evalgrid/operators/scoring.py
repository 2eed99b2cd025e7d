"""From answered trials to one accuracy and bias row per tuple."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalgrid.functions import lookups as L
from evalgrid.functions.numbers import ratio, total
from evalgrid.operators.skew import with_group_totals

TUPLE_KEYS = ("modelname", "tuple_ID")

# Meaningless once the rows of a tuple are one row.
_SPENT = ("resp", "goldresp", "text", "acc_weight")
_COMPUTED = ("acc", "bias", "tuplelen", "expectedresp_len")


def add_score_columns(df: DataFrame) -> DataFrame:
    """Weight of each question, and accuracy and bias of each response."""
    return df.withColumns({
        "acc_weight": L.gold_weight("goldresp"),
        "bias": L.response_bias("resp"),
        "acc": L.folded_accuracy("resp", "goldresp"),
    })


def with_group_size(df: DataFrame, by: Sequence[str] = TUPLE_KEYS, name: str = "tuplelen") -> DataFrame:
    """Add the number of rows of each row's group, rows without response included."""
    return with_group_totals(df, by, {name: F.count(F.lit(1))})


def with_group_minimum(
    df: DataFrame, by: Sequence[str], field: str, name: str | None = None
) -> DataFrame:
    """Replace ``field`` (or add ``name``) by its minimum in the row's group."""
    return with_group_totals(df, by, {name or field: F.min(field).cast("double")})


def filter_complete_tuples(
    df: DataFrame, tuple_keys: Sequence[str] = TUPLE_KEYS
) -> DataFrame:
    """Keep the rows whose tuple has as many rows as the row has accepted answers."""
    return (
        with_group_size(df, tuple_keys, "tuplelen")
        .withColumn("expectedresp_len", F.array_size("expectedresp"))
        .where(F.col("tuplelen") == F.col("expectedresp_len"))
    )


def tuple_completeness(df: DataFrame, tuple_keys: Sequence[str] = TUPLE_KEYS) -> DataFrame:
    """What ``filter_complete_tuples`` keeps and drops, by model.

    ``n_rows`` and ``n_kept`` count rows, ``complete``, ``incomplete`` and ``overfull`` tuples; a
    tuple whose rows accept different numbers of answers counts once for each number.
    """
    keys, size = list(tuple_keys), F.array_size("expectedresp").alias("size")
    by_model = [k for k in keys if k == "modelname"]
    sizes = df.dropna(subset=keys).select(*keys, size).groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    sizes = sizes.withColumn("whole", whole)
    right, n = F.col("whole") == F.col("size"), F.col("n")
    return sizes.groupBy(*by_model).agg(
        F.sum(n).alias("n_rows"), F.coalesce(F.sum(F.when(right, n)), F.lit(0)).alias("n_kept"), F.count_if(right).alias("complete"),
        F.count_if(F.col("whole") < F.col("size")).alias("incomplete"), F.count_if(F.col("whole") > F.col("size")).alias("overfull"),
    )


def _weighted_means(fields: Sequence[str], weight: str) -> dict[str, Column]:
    weights = F.sum(F.col(weight).cast("double"))
    # a missing value adds nothing to the sum, yet its weight counts
    return {f: ratio(total(F.col(f) * F.col(weight)), weights) for f in fields}


def weighted_means_by_group(
    df: DataFrame, by: Sequence[str], fields: Sequence[str] | str, weightfield: str
) -> DataFrame:
    """One row per group with the weighted mean of each field."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    means = _weighted_means(fields, weightfield)
    return df.dropna(subset=list(by)).groupBy(*by).agg(*(c.alias(n) for n, c in means.items()))


def transform_into_weighted_mean(
    df: DataFrame,
    by: Sequence[str],
    fields: Sequence[str] | str,
    weightfield: str,
) -> DataFrame:
    """Replace each field by its weighted mean in the row's group; keeps every row."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    return with_group_totals(df, by, _weighted_means(fields, weightfield))


def row_order(df: DataFrame) -> Column:
    """Order of rows inside a tuple: results file, then trials row, then key."""
    names = [c for c in ("prompting", "EXP_i", "Key") if c in df.columns]
    return F.struct(*map(L.named, names or sorted(df.columns)))


# Columns that tell the rows of a file apart, in the order that counts.
_PLACES = ("EXP_i", "Key")
# 65 bits for each of them: a 64-bit number, or the one below all of them for NULL.
_LOWEST, _RANGE = -(1 << 63) - 1, 1 << 65


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _place(names: Sequence[str]) -> Column:
    """One number that orders rows like their (EXP_i, Key), or like the one there is of them; NULL first.

    A hash aggregate can keep the least of such numbers, but not of structs. One column is its own
    number; two need 38 digits. Row numbers are not negative.
    """
    if len(names) == 1:
        return F.col(names[0]).cast("bigint")
    place = F.coalesce(F.col("EXP_i"), F.lit(-1)).cast("decimal(38,0)")
    key = F.coalesce(F.col("Key").cast("decimal(38,0)"), _number(_LOWEST)) - _number(_LOWEST)
    place = (place * _number(_RANGE)).cast("decimal(38,0)") + key
    return place.cast("decimal(38,0)")


def _from_place(place: Column, names: Sequence[str]) -> dict[str, Column]:
    """The columns out of their number."""
    if len(names) == 1:
        return {names[0]: place}
    key = F.pmod(place, _number(_RANGE))
    row = F.call_function("div", (place - key).cast("decimal(38,0)"), _number(_RANGE))
    return {
        "Key": F.nullif(key + _number(_LOWEST), _number(_LOWEST)).cast("bigint"),
        "EXP_i": F.nullif(row.cast("bigint"), F.lit(-1).cast("bigint")),
    }


def first_row_per_group(
    df: DataFrame, by: Sequence[str] = TUPLE_KEYS, order: Column | None = None
) -> DataFrame:
    """The first row of each group, as an aggregate rather than a sorted window."""
    by = list(by)
    others = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*map(L.named, others)), row_order(df) if order is None else order)
    return (
        df.dropna(subset=by)
        .groupBy(*by)
        .agg(first.alias("__row"))
        .select(*by, *(F.col("__row")[c].alias(c) for c in others))
    )


def _groupable(kind: T.DataType) -> bool:
    """Whether Spark can group by a column of this type."""
    if isinstance(kind, T.ArrayType):
        return _groupable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_groupable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def compute_acc_table(
    df: DataFrame,
    filter_incomplete_tuples: bool = True,
    tuple_keys: Sequence[str] = TUPLE_KEYS,
    carry: Sequence[str] | None = None,
    uniform_lengths: bool = False,
) -> DataFrame:
    """Reduce each tuple of dependent trials to one row with ``acc`` and ``bias``.

    A row counts only if its tuple has as many rows as the row has accepted answers.
    The other columns come from the first row that counts: all of them but those that
    mean nothing any more (``text`` above all), or those named in ``carry``. Naming the
    few that are needed keeps the exchange narrow.

    Tuples are keyed without ``prompting``, so a model answering under two promptings
    loses its tuples as overfull; add it to ``tuple_keys`` for such data.

    Rows of one tuple may in principle accept different numbers of answers, so rows
    are first reduced per number of answers, and a second, smaller exchange finds the
    size of the whole tuple. ``uniform_lengths`` saves the window over the tuple where the
    caller knows the number to be constant in it, and the exchange if nothing is carried;
    a tuple that breaks this, and whose result would depend on it, is an error.

    In place of ``expectedresp`` its size ``expectedresp_len`` will do.
    """
    keys = list(tuple_keys)
    length = "expectedresp_len"
    sized = F.array_size("expectedresp") if "expectedresp" in df.columns else F.col(length)
    dropped = {*keys, *_SPENT, *_COMPUTED}
    carried = [c for c in (df.columns if carry is None else carry) if c not in dropped]
    rows = (
        df.dropna(subset=keys)
        .transform(add_score_columns)
        .withColumn(length, sized)
    )
    complete = F.col("tuplelen") == F.col("expectedresp_len")
    sizes = ["tuplelen", "expectedresp_len"] if filter_incomplete_tuples else []
    places = [c for c in _PLACES if c in df.columns]
    plain = all(isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType)) for c in places)
    kinds = [df.schema[c].dataType for c in carried if c in df.columns]
    if carried and places and plain and all(map(_groupable, kinds)):
        kept = _reduce_in_steps(rows, keys, carried, places, filter_incomplete_tuples, uniform_lengths)
        return kept.select(*keys, *carried, *sizes, "acc", "bias")

    figures = [c.alias(n) for n, c in _weighted_means(["acc", "bias"], "acc_weight").items()]
    figures.append(F.count(F.lit(1)).alias("tuplelen"))
    if carried:
        figures.append(F.min_by(F.struct(*map(L.named, carried)), row_order(df)).alias("__first"))
    if not filter_incomplete_tuples:
        kept = rows.groupBy(*keys).agg(*figures).drop("tuplelen")
    elif uniform_lengths:
        kept = _keep_uniform(rows, keys, figures)
    else:
        # one row per tuple and number of answers is left, so this window is narrow
        whole = F.sum("tuplelen").over(Window.partitionBy(*keys))
        reduced = rows.groupBy(*keys, "expectedresp_len").agg(*figures)
        kept = reduced.withColumn("tuplelen", whole).where(complete)
    firsts = [F.col("__first")[c].alias(c) for c in carried]
    return kept.select(*keys, *firsts, *sizes, "acc", "bias")


def _packable(kind: T.DataType) -> bool:
    """Whether values of this type are the same again after a way through text, and equal if their texts are."""
    return kind == T.StringType() or isinstance(kind, (T.IntegralType, T.BooleanType))


# What stands between packed fields, and what stands for it, for itself and for NULL inside them.
_BETWEEN, _MARK = "\u0000", "\u0001"


def _packed(names: Sequence[str], kinds: Mapping[str, T.DataType]) -> Column:
    """The fields as one text."""
    def text(name):
        c = L.named(name)
        if kinds[name] != T.StringType():
            return c.cast("string")
        return F.replace(F.replace(c, F.lit(_MARK), F.lit(f"{_MARK}b")), F.lit(_BETWEEN), F.lit(f"{_MARK}a"))

    return F.concat_ws(_BETWEEN, *(F.coalesce(text(c), F.lit(f"{_MARK}n")) for c in names))


def _unpacked(packed: Column, names: Sequence[str], kinds: Mapping[str, T.DataType]) -> dict[str, Column]:
    """The fields out of their text."""
    def field(i, name):
        x = F.nullif(F.substring_index(F.substring_index(packed, _BETWEEN, i + 1), _BETWEEN, -1), F.lit(f"{_MARK}n"))
        if kinds[name] != T.StringType():
            return x.cast(kinds[name])
        return F.replace(F.replace(x, F.lit(f"{_MARK}a"), F.lit(_BETWEEN)), F.lit(f"{_MARK}b"), F.lit(_MARK))

    return {c: field(i, c) for i, c in enumerate(names)}


def _reduce_in_steps(
    rows: DataFrame, keys: Sequence[str], carried: Sequence[str], places: Sequence[str], complete_only: bool, uniform: bool
) -> DataFrame:
    """Tuples out of rows, with nothing in the first step that a hash aggregate cannot keep.

    Rows of a tuple mostly agree in what is carried, so that is part of the first step's
    key; its few rows per tuple are then put together, the first row's fields by its place.
    Texts and numbers that are carried cross the exchanges as one text, which is much shorter there
    than columns of their own.
    """
    length = "expectedresp_len"
    fixed = [c for c in carried if c not in places]
    file = [c for c in ("prompting",) if c in rows.columns and c not in (*fixed, *keys)]
    weight = F.col("acc_weight").cast("double")
    kinds = {c: rows.schema[c].dataType for c in fixed}
    packed = [c for c in fixed if _packable(kinds[c])]
    if len(packed) > 1:
        fixed = [*(c for c in fixed if c not in packed), "__packed"]
        rows = rows.withColumn("__packed", _packed(packed, kinds))
    else:
        packed = []
    part = rows.groupBy(*keys, length, *fixed, *file).agg(
        F.count(F.lit(1)).alias("tuplelen"), F.sum(weight).alias("__weights"),
        *(F.sum(F.col(f) * F.col("acc_weight")).alias(f"__{f}") for f in ("acc", "bias")),
        F.when(~F.bool_or(_place(places).isNull()), F.min(_place(places))).alias("__place"),
    )
    if complete_only and uniform:
        part = part.repartition(*keys)  # or rows would be sorted on both sides of the exchange
    elif complete_only:
        whole = F.sum("tuplelen").over(Window.partitionBy(*keys))
        part = part.withColumn("tuplelen", whole).where(F.col("tuplelen") == F.col(length))
    if "prompting" in packed:
        part = part.withColumn("prompting", _unpacked(F.col("__packed"), packed, kinds)["prompting"])
    prompting = [c for c in ("prompting",) if c in part.columns]
    order = F.struct(*prompting, "__place")  # a NULL place is the first
    first = F.min_by(F.struct(*map(L.named, fixed), "__place"), order)
    weights = F.sum("__weights")
    size = (F.sum if uniform else F.max)("tuplelen").alias("tuplelen")
    kept = part.groupBy(*keys).agg(
        first.alias("__first"), size, F.min(length).alias(length), F.max(length).alias("__longest"),
        *(ratio(total(F.col(f"__{f}")), weights).alias(f) for f in ("acc", "bias")),
    )
    if complete_only and uniform:
        kept = _uniform(kept, keys)
    found = _from_place(F.col("__first")["__place"], places)
    fields = {c: F.col("__first")[c] for c in fixed if c != "__packed"} | {c: found[c] for c in carried if c in places}
    if packed:
        fields |= _unpacked(F.col("__first")["__packed"], packed, kinds)
    fields = {c: fields[c] for c in carried}
    return kept.select(*keys, *(x.alias(c) for c, x in fields.items()), "tuplelen", length, "acc", "bias")


def _keep_uniform(rows: DataFrame, keys: Sequence[str], figures: Sequence[Column]) -> DataFrame:
    """Complete tuples, on the understanding that each has one number of answers."""
    reduced = rows.groupBy(*keys).agg(
        *figures,
        F.min("expectedresp_len").alias("expectedresp_len"),
        F.max("expectedresp_len").alias("__longest"),
    )
    return _uniform(reduced, keys)


def _uniform(reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Those of reduced tuples that are complete; one for which this depends on the row is an error."""
    size, shortest, longest = F.col("tuplelen"), F.col("expectedresp_len"), F.col("__longest")
    message = F.concat(
        F.lit("tuple with mixed numbers of accepted answers: "), F.to_json(F.struct(*keys))
    )
    undecided = (shortest < longest) & size.between(shortest, longest)
    problem = F.raise_error(message).cast("boolean")
    return reduced.where(F.when(undecided, problem).otherwise(size == shortest))
