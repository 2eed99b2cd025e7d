"""Moments and the text form of a mean with its confidence interval."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalgrid.constants import CONF95
from evalgrid.functions.lookups import column

# Below this a variance is cancellation noise.
_NOISE = 1e-12

CELL_STYLES = ("mean", "conf", "tuple", "str", "latex")


def total(x: Column) -> Column:
    """Sum in which nothing but missing values adds up to 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def root(x: Column) -> Column:
    """Square root, NULL for a negative value (sqrt would give NaN)."""
    return F.when(x >= 0, F.sqrt(x))


def without_noise(var: Column) -> Column:
    return F.when(F.abs(var) < _NOISE, F.lit(0.0)).otherwise(var)


def conf95(sem: Column) -> Column:
    return F.lit(CONF95) * sem


def fixed_decimals(x: Column, decimals: int) -> Column:
    plain = F.replace(F.format_number(x, decimals), F.lit(","), F.lit(""))
    return F.coalesce(plain, F.lit("nan"))


def format_cell(
    mean: Column | str, sem: Column | str, cell_style: str = "str", scale: float = 100.0
) -> Column:
    """One table cell.

    ``mean`` and ``conf`` are numbers, ``tuple`` is a struct of both, ``str`` reads
    ``mean (conf)`` and ``latex`` sets the interval in small type. Percentages
    (scale 100) show one decimal, other scales two.
    """
    value = F.lit(float(scale)) * column(mean)
    conf = F.lit(float(scale) * CONF95) * column(sem)
    if cell_style == "mean":
        return value
    if cell_style == "conf":
        return conf
    if cell_style == "tuple":
        return F.struct(value.alias("mean"), conf.alias("conf"))
    decimals = 1 if scale == 100 else 2
    shown, margin = fixed_decimals(value, decimals), fixed_decimals(conf, decimals)
    if cell_style == "str":
        return F.concat(shown, F.lit(" ("), margin, F.lit(")"))
    if cell_style == "latex":
        return F.concat(shown, F.lit(r"{\tiny $\pm "), margin, F.lit("$}"))
    raise ValueError(f"cell_style must be one of {CELL_STYLES}, not {cell_style!r}")


def drawn(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**60 - 1 that the parts decide: the first hex digits of the MD5 of their text.

    Any engine that has MD5 can repeat it. A missing part counts as empty text.
    """
    texts = [F.lit(str(p)) if isinstance(p, int) else F.coalesce(column(p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *texts)), 1, 15), 16, 10).cast("bigint")
