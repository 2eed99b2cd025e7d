"""Labels read off file names, and the display order of labels."""

import posixpath
import re
from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid import constants as K
from evalgrid.functions.lookups import column, lookup

_LEGACY_NAME = r"^(.+__allresults\.[A-Za-z]+(?:\.partial)?)$"
_FORMS = (
    "'<prompting>___<modelname>___results.jsonl', '<modelname>__allresults.<ext>' "
    "or '<modelname>__allresults.<ext>.partial'"
)


def plain_path(path: Column | str) -> Column:
    """Undo the percent-encoding of ``_metadata.file_path``.

    The encoding leaves ``+`` alone while decoding would turn it into a space.
    """
    return F.url_decode(F.replace(column(path), F.lit("+"), F.lit("%2B")))


def logical_file(path: Column | str) -> Column:
    """The file itself, or the folder of that name when Spark wrote it in parts."""
    return F.regexp_replace(column(path), r"/part-[0-9]+[^/_]*$", "")


def whole_file(path: str) -> str:
    """``logical_file`` and ``plain_path`` of one path known on the driver."""
    return re.sub(r"/part-[0-9]+[^/_]*$", "", unquote(path))


def experiment_folder(path: Column | str) -> Column:
    """Folder of an experiment, from the path of its trials file."""
    return F.regexp_replace(logical_file(path), r"/[^/]+$", "")


def experiment_folder_of_results(path: Column | str) -> Column:
    """Folder of an experiment, from a results file one folder further down."""
    return F.regexp_replace(logical_file(path), r"/[^/]+/[^/]+$", "")


def experiment_name(folder: Column | str) -> Column:
    return F.regexp_extract(column(folder), r"([^/]+)/*$", 1)


def with_labels(df: DataFrame, path: Column | str = "_metadata.file_path") -> DataFrame:
    """Add ``modelname`` and ``prompting`` as the results path of each row tells them.

    ``prompting`` is NULL for a name that carries none; a path of another form is an
    error. The path may be percent-encoded, as the file sources report it. The steps
    are columns of their own, so that each is evaluated once per row.
    """
    path = column(path)
    named = path.endswith(K.RESULTS_ENDING) | path.contains(K.RESULTS_ENDING + "/")
    last, before_last = F.substring_index(path, "/", -1), F.substring_index(path, "/", -2)
    is_part = last.startswith("part-") & ~last.contains("__")
    file = F.when(is_part, F.substring_index(before_last, "/", 1)).otherwise(last)
    encoded, parts = F.col("__file"), F.col("__parts")
    name = F.when(encoded.contains("%"), plain_path(encoded)).otherwise(encoded)
    standard = F.when(F.col("__named"), F.split("__name", "___"))
    legacy = F.regexp_extract("__name", _LEGACY_NAME, 1)
    unknown = F.raise_error(F.concat(F.lit(f"no labels, expected {_FORMS}: "), "__name"))
    model = (
        F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(2)))
        .when(~F.col("__named") & (legacy != ""), F.substring_index(legacy, "__", 1))
        .otherwise(unknown.cast("string"))
    )
    prompting = F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(1)))
    columns = df.columns
    return (
        df.select("*", file.alias("__file"), named.alias("__named"))
        .withColumn("__name", name)
        .withColumn("__parts", standard)
        .select(*columns, model.alias("modelname"), prompting.alias("prompting"))
    )


def infer_modelname_and_prompting(path: str) -> tuple[str, str | None]:
    """The same two labels for one path known on the driver."""
    name = posixpath.basename(path.rstrip("/"))
    if name.endswith(K.RESULTS_ENDING):
        parts = name.split("___")
        if len(parts) == 3:
            return parts[1], parts[0]
    else:
        stem = name.removesuffix(".partial")
        head, dot, extension = stem.rpartition(".")
        if dot and extension.isalpha() and head.endswith(K.LEGACY_ENDING):
            return name.split("__")[0], None
    raise ValueError(f"no labels in {path!r}, expected {_FORMS}")


def label_rank(
    c: Column | str, field: str, order: Mapping[str, Sequence[str]] = K.DISPLAY_ORDER
) -> Column:
    """Position of a label in its preferred order; labels outside it come last."""
    known = order.get(field, ())
    if not known:
        return F.lit(0)
    ranks = {value: i for i, value in enumerate(known)}
    return F.coalesce(lookup(c, ranks), F.lit(len(known)))


def sorted_for_display(
    rows: Iterable[Sequence],
    fields: Sequence[str],
    order: Mapping[str, Sequence[str]] = K.DISPLAY_ORDER,
) -> list[tuple]:
    """Label combinations already on the driver, in the order of ``display_order``."""
    ranks = [{v: i for i, v in enumerate(order.get(f, ()))} for f in fields]

    def key(row):
        return [(known.get(v, len(known)), v is not None, v) for v, known in zip(row, ranks, strict=True)]

    return sorted(map(tuple, rows), key=key)


def display_order(
    fields: Sequence[str], order: Mapping[str, Sequence[str]] = K.DISPLAY_ORDER
) -> list[Column]:
    """Sort keys: preferred order first, then the value itself."""
    keys = []
    for field in fields:
        if field in order:
            keys.append(label_rank(field, field, order))
        keys.append(F.col(field))
    return keys
