"""The derived trials and responses, and the scoring rules, as plain SQL.

The rules are written here the long way round (windows over whole groups), so that
comparing both sides checks the shorter forms the engine uses.
"""

from collections.abc import Mapping, Sequence

from evalgrid import constants as K
from evalgrid.plans import derived as D


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def case(column: str, table: Mapping, otherwise: str = "NULL") -> str:
    """A table lookup as CASE."""

    def literal(v):
        return text(v) if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def rounded(expression: str, name: str) -> str:
    """Rounded to six decimals, without the sign of a zero."""
    r = f"round(({expression})::DOUBLE, 6)"
    return f"CASE WHEN {r} = 0 THEN 0::DOUBLE ELSE {r} END AS {name}"


_ACCEPTED = (
    f"CASE WHEN o_orderkey % 6 < 2 THEN {array(D.ANSWERS[0])} "
    f"WHEN o_orderkey % 6 < 4 THEN {array(D.ANSWERS[1])} ELSE {array(D.ANSWERS[2])} END"
)
_NEXT = 'expectedresp[("Key" % 10) % len(expectedresp) + 1]'
_MODELS = ", ".join(f"({m}, {text(name)})" for m, name in enumerate(D.MODELS))

BASE = f"""
WITH tuples AS (
  SELECT o_orderkey AS o, {_ACCEPTED} AS expectedresp FROM orders
),
trials AS (
  SELECT o * 10 + i AS "Key",
         'Q' || o || '.' || i AS text,
         expectedresp,
         expectedresp[i] AS goldresp,
         {array(D.PROBLEMS)}[o % 6 + 1] AS problemname,
         (3 + (o // 6) % 3)::INTEGER AS problemsize,
         {array(D.SKIN_CYCLE)}[(o // 108) % {len(D.SKIN_CYCLE)} + 1] AS skin,
         o AS tuple_ID,
         'Complexity_' || ((o // 18) % 3) AS complexity,
         (2 + (o // 54) % 2)::INTEGER AS query_len
  FROM tuples, unnest(range(1, len(expectedresp) + 1)) AS u(i)
),
older_trials AS (
  SELECT * REPLACE ({array(D.OLDER_PROBLEMS)}[tuple_ID % 6 + 1] AS problemname) FROM trials
),
answers AS (
  SELECT "Key", expectedresp, goldresp, modelname,
         (((("Key" % 10007) * 7919 + m * 104729) % 9973) % 100) AS r, m
  FROM trials, (VALUES {_MODELS}) AS v(m, modelname)
  WHERE NOT (m = 1 AND "Key" % 97 = 0) AND NOT (m = 2 AND tuple_ID % 5 = 0)
),
results AS (
  SELECT "Key",
         CASE WHEN r = 0 THEN '' WHEN r = 1 THEN 'MAYBE' WHEN r < 45 + 15 * m THEN goldresp
              ELSE {_NEXT} END AS resp,
         modelname, {text(D.PROMPTING)} AS prompting
  FROM answers
),
assembled AS (
  SELECT t.*, r.resp, r.modelname, r.prompting FROM results r JOIN trials t ON r."Key" = t."Key"
),
scored AS (
  SELECT *, {case("goldresp", K.GOLD_WEIGHT)}::DOUBLE AS acc_weight,
         {case("resp", K.ANSWER_BIAS)}::DOUBLE AS bias,
         CASE WHEN {case("resp", K.FOLDED_ANSWER)} = {case("goldresp", K.FOLDED_ANSWER)}
              THEN 1 ELSE 0 END AS acc
  FROM assembled
),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY modelname, tuple_ID) AS tuplelen,
         len(expectedresp)::INTEGER AS expectedresp_len
  FROM scored
),
acc AS (
  SELECT modelname, tuple_ID, min("Key") AS "Key", arg_min(prompting, "Key") AS prompting,
         arg_min(problemname, "Key") AS problemname, arg_min(problemsize, "Key") AS problemsize,
         arg_min(skin, "Key") AS skin, arg_min(complexity, "Key") AS complexity,
         arg_min(query_len, "Key") AS query_len, arg_min(tuplelen, "Key") AS tuplelen,
         arg_min(expectedresp_len, "Key") AS expectedresp_len,
         coalesce(sum(acc * acc_weight), 0) / nullif(sum(acc_weight), 0) AS acc,
         coalesce(sum(bias * acc_weight), 0) / nullif(sum(acc_weight), 0) AS bias
  FROM sized WHERE tuplelen = expectedresp_len
  GROUP BY modelname, tuple_ID
)"""


def query(body: str, *ctes: str) -> str:
    return ",\n".join([BASE, *ctes]) + "\n" + body


def level0(source: str, by: Sequence[str], field: str, name: str) -> str:
    """Common table ``name`` with the plain statistics of a field per group."""
    keys = ", ".join(by)
    present = " AND ".join(f"{k} IS NOT NULL" for k in by)
    return f"""{name} AS (
  SELECT {keys}, avg({field}) AS mean, count({field})::DOUBLE AS count,
         var_samp({field}) AS var, stddev_samp({field}) AS std,
         stddev_samp({field}) / sqrt(nullif(count({field}), 0)) AS sem
  FROM {source} WHERE {present} GROUP BY {keys}
)"""


def merged(source: str, by: Sequence[str], name: str, rebalance: bool = True) -> str:
    """Common tables ending in ``name``: the statistics of ``source`` merged into ``by``."""
    keys = ", ".join(by)
    c = f"min(count) OVER (PARTITION BY {keys})" if rebalance else "count"
    return f"""{name}_c AS (SELECT *, {c} AS c FROM {source}),
{name}_s AS (
  SELECT {keys}, sum(c) AS count, coalesce(sum(c * mean), 0) AS sum,
         coalesce(sum(c * (var + mean * mean)), 0) AS sum_sq
  FROM {name}_c GROUP BY {keys}
),
{name}_m AS (
  SELECT *, sum / nullif(count, 0) AS mean, sum_sq / nullif(count, 0) AS mean_sq FROM {name}_s
),
{name}_v AS (
  SELECT *, CASE WHEN abs(mean_sq - mean * mean) < 1e-12 THEN 0 ELSE mean_sq - mean * mean END AS var
  FROM {name}_m
),
{name} AS (
  SELECT *, CASE WHEN var >= 0 THEN sqrt(var) END AS std,
         CASE WHEN var >= 0 THEN sqrt(var) END / sqrt(nullif(count, 0)) AS sem
  FROM {name}_v
)"""


PLAIN = ("mean", "sem", "count", "var", "std")
POOLED = (*PLAIN, "sum", "sum_sq", "mean_sq")


def shown(source: str, keys: Sequence[str], figures: Sequence[str], conf95: bool = True) -> str:
    columns = [*keys, *(rounded(f, f) for f in figures)]
    if conf95:
        columns.append(rounded("1.96 * sem", "conf95"))
    return f"SELECT {', '.join(columns)} FROM {source}"
