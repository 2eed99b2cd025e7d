"""Laying statistics out as a table of formatted cells."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid import constants as K
from evalgrid.functions.labels import display_order, sorted_for_display
from evalgrid.functions.numbers import format_cell

# Columns of a statistics table that are figures, not keys.
FIGURES = ("mean", "sem", "count", "var", "std", "conf95", "sum", "sum_sq", "mean_sq")

# Between the values of several pivoted fields in one column name.
SEPARATOR = " | "


def varying_fields(stats: DataFrame, fields: Sequence[str]) -> list[str]:
    """The fields with more than one value, found in one small aggregate."""
    if not fields:
        return []
    spread = [(F.min(f) != F.max(f)).alias(f) for f in fields]
    row = stats.agg(*spread).first()
    return [f for f in fields if row[f]]


def sort_for_display(
    df: DataFrame, order_prefs: Mapping[str, Sequence[str]] = K.DISPLAY_ORDER
) -> DataFrame:
    """Rows in the preferred order of every label column that has one."""
    return df.orderBy(*display_order([c for c in df.columns if c in order_prefs], order_prefs))


def pivot_pretty(
    stats: DataFrame,
    columns: Sequence[str] | str = (),
    index: Sequence[str] | None = None,
    cell_style: str = "str",
    order_prefs: Mapping[str, Sequence[str]] = K.DISPLAY_ORDER,
    scale: float = 100.0,
    valname: str = "value",
    heads: Sequence[Sequence] | None = None,
) -> DataFrame:
    """A display table: ``index`` fields down, values of ``columns`` across.

    Without ``index`` the keys that vary and are not in ``columns`` are used. Rows and
    columns follow the preferred order of their labels. Where ``index`` leaves out a
    varying key, the cell of its first value is shown.

    The statistics are read up to three times (values of ``columns``, varying keys,
    cells): pass a table that is kept, such as one of ``session.materialise``, or name
    the values of ``columns`` in ``heads`` and the ``index``.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    keys = [c for c in stats.columns if c not in FIGURES]
    if index is None:
        index = varying_fields(stats, [k for k in keys if k not in columns])
    index = list(index)
    if not index and not columns:
        raise ValueError("a table needs an index field or a column field")

    cells = stats.select(
        *keys, format_cell("mean", "sem", cell_style, scale).alias(valname)
    )
    if cell_style in ("mean", "conf"):
        # a row or column without any number is not shown
        cells = cells.where(F.col(valname).isNotNull())
    left_out = [k for k in keys if k not in index and k not in columns]

    def first(here: Column | None = None) -> Column:
        """The cell of the first of the left-out keys' values, among the rows that are here."""
        if left_out:
            order = F.struct(*left_out)
            return F.min_by(valname, order if here is None else F.when(here, order))
        return F.first(valname if here is None else F.when(here, F.col(valname)), ignorenulls=here is not None)

    if not columns:
        table = cells.groupBy(*index).agg(first().alias(valname))
        return table.orderBy(*display_order(index, order_prefs))

    most = int(stats.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if heads is None:
        heads = stats.select(*columns).distinct().limit(most + 1).collect()
    if len(heads) > most:
        raise ValueError(f"{columns} have too many values to be column heads")
    heads = sorted_for_display(heads, columns, order_prefs)
    # values are compared as what they are, names are only shown
    figures = []
    for head, name in zip(heads, _head_names(heads), strict=True):
        here = F.lit(True)
        for c, value in zip(columns, head, strict=True):
            here = here & F.col(c).eqNullSafe(F.lit(value).cast(stats.schema[c].dataType))
        figures.append(first(here).alias(name))
    table = cells.groupBy(*index).agg(*figures) if figures else cells.select(*index).distinct()
    if index:
        table = table.orderBy(*display_order(index, order_prefs))
    return table


def _head_names(heads: Sequence[Sequence]) -> list[str]:
    """Names of column heads as Spark would write their values; a separator inside of one is doubled."""

    def shown(value) -> str:
        text = "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        return text.replace(SEPARATOR, SEPARATOR + SEPARATOR) if len(heads[0]) > 1 else text

    return [SEPARATOR.join(map(shown, h)) for h in heads]
