"""Column expressions over the fixed vocabularies."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalgrid import constants as K


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(c: Column | str, table: Mapping) -> Column:
    """Value of ``c`` in a literal table; NULL for a miss and for NULL."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)[column(c)]


def replaced(c: Column | str, table: Mapping) -> Column:
    """Like ``lookup`` but leaves values outside the table as they are."""
    return F.coalesce(lookup(c, table), column(c))


def gold_weight(gold: Column | str) -> Column:
    return lookup(gold, K.GOLD_WEIGHT)


def response_bias(resp: Column | str) -> Column:
    return lookup(resp, K.ANSWER_BIAS)


def folded_answer(resp: Column | str) -> Column:
    return lookup(resp, K.FOLDED_ANSWER)


def folded_accuracy(resp: Column | str, gold: Column | str) -> Column:
    """1 when both answers fold to the same known answer, else 0, never NULL."""
    same = folded_answer(resp) == folded_answer(gold)
    return F.coalesce(same, F.lit(False)).cast("int")


def arity_name(query_len: Column | str) -> Column:
    return lookup(column(query_len).cast("int"), K.ARITY_NAME)


def global_complexity(complexity: Column | str, query_len: Column | str) -> Column:
    level = lookup(complexity, K.COMPLEXITY_LEVEL) + column(query_len).cast("int") - 2
    # least() skips NULL, a missing level has to stay missing
    return F.when(level.isNotNull(), F.least(level, F.lit(2)))


def is_control(problemname: Column | str) -> Column:
    return F.coalesce(column(problemname).isin(*K.CONTROL_PROBLEMS), F.lit(False))


def answer_is_valid(resp: Column | str, expected: Column | str) -> Column:
    """No answer at all is valid, anything else has to be an accepted answer."""
    r = column(resp)
    return r.isNull() | (r == "") | F.coalesce(F.array_contains(column(expected), r), F.lit(False))


def reprompt(text: Column | str, expected: Column | str) -> Column:
    options = F.array_join(column(expected), ", ")
    return F.concat(column(text), F.lit(f"\n{K.REPROMPT}["), options, F.lit("]"))
