"""URL filter: block and allow rules, spread over redirects and canonical links."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import table
from evalgrid.llm.components import connected_components
from evalgrid.session import materialise

#: (verdict, rule) of the query; a rule is a host and a path
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _node(url: Column) -> Column:
    """What a URL names, without scheme and fragment; NULL if it names no host."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(_host(url) != "", F.concat(F.lit("://"), _host(url), rest))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or NULL."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def link_targets(html: Column, tag: str, marked: str, target: str) -> Column:
    """Values that ``target`` captures in those ``tag`` elements in which ``marked`` is found."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?-->|<script\\b.*?</script\\s*>", " ")
    found = F.regexp_extract_all(bare, F.lit(f"(?is)<{tag}\\b[^>]*>"), F.lit(0))
    found = F.filter(found, lambda x: x.rlike(marked))
    return F.transform(found, lambda x: F.trim(F.regexp_extract(x, target, 1)))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute URL for a link found on the page ``url``."""
    origin = F.regexp_extract(url, "^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page's own address and where its canonical link or its redirect points.

    Links in comments and scripts do not count, nor do empty ones.
    """
    canonical = link_targets(
        F.col("html"), "link", "(?is)\\brel\\s*=\\s*[\"']?[^\"'>]*\\bcanonical\\b", "(?is)\\bhref\\s*=\\s*[\"']?([^\"'>\\s]*)"
    )
    redirect = link_targets(
        F.col("html"), "meta", "(?is)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b", "(?is)\\burl\\s*=\\s*[\"']?([^\"'>\\s]*)"
    )
    links = pages.select("url", F.explode(F.concat(canonical, redirect)).alias("target")).where("target <> ''")
    target = _resolved(F.col("target"), F.col("url"))
    return links.select(_node(F.col("url")).alias("a"), _node(target).alias("b")).where("a <> b").distinct()


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ``by`` (rule, alias or default) of every row of ``pages``.

    A page's own rule decides first, the longest that fits. Where none fits, the page follows the
    addresses that redirects and canonical links tie it to, however long the chain: allowed if a rule
    allows one of them, else blocked if a rule blocks one of them, else allowed. Addresses are
    compared without scheme and fragment.

    NULL and addresses without ``://`` have empty host and path, fit no rule and are tied to nothing:
    they are allowed. Repeated pages are judged alike, each in its row. No pages, no rows; columns
    other than page_id, url and html are ignored. ``rules`` is a short list; it becomes an expression.
    """
    pages = pages.select("page_id", "url", "html")
    nodes = connected_components(alias_edges(pages))
    own = _verdict(_rule(_host(F.col("node")), _path(F.col("node")), rules), rules)
    nodes = materialise(nodes.withColumn("own", own), "aliases")
    decided = nodes.groupBy("component").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")
    )
    # only blocks need to reach the pages; allowed is what remains
    blocked = decided.where("blocked and not allowed").select("component")
    spread = materialise(nodes.join(blocked, "component").select("node").distinct(), "blocked_aliases")
    spread = spread.withColumn("tied", F.lit(True))
    judged = pages.select(
        "page_id", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), _node(F.col("url")).alias("node")
    ).withColumn("rule", _rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(_verdict(F.col("rule"), rules), F.when(F.col("tied"), F.lit("block")), F.lit("allow"))
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("tied"), "alias").otherwise("default")
    return judged.join(spread, "node", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_rule(host: str, path: str) -> str:
    whens = []
    for _, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, slash, rest = rule.partition("/")
        whens.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{slash}{rest}') THEN '{rule}'")
    return "CASE " + " ".join(whens) + " END"


def _sql_parts(url: str) -> tuple[str, str]:
    host = f"translate(regexp_extract(coalesce({url}, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    return host, f"regexp_extract(coalesce({url}, ''), '://[^/?#]*([^?#]*)', 1)"


def _sql_node(url: str) -> str:
    host = _sql_parts(url)[0]
    return f"CASE WHEN {host} <> '' THEN '://' || {host} || regexp_extract({url}, '://[^/?#]*([^#]*)', 1) END"


_SQL_VERDICT = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES) + " END"

SQL = f"""
WITH RECURSIVE bare AS (
  SELECT url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', ' ', 'g') AS html FROM pages
), tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag, true AS canonical FROM bare
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')), false FROM bare
), links AS (
  SELECT url, trim(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''>\\s]*)', 1)) AS target FROM tags
  WHERE canonical AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
  UNION ALL SELECT url, trim(regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''>\\s]*)', 1)) FROM tags
  WHERE NOT canonical AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
), resolved AS (
  SELECT url, CASE WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || target
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1) ||
      coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || target END AS target
  FROM links WHERE target <> ''
), edges AS (
  SELECT DISTINCT {_sql_node('url')} AS a, {_sql_node('target')} AS b FROM resolved
), ties AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(node, other) AS (
  SELECT a, a FROM ties UNION SELECT r.node, e.b FROM reach r JOIN ties e ON r.other = e.a
), ruled AS (
  SELECT node, {_sql_rule(*_sql_parts('other'))} AS rule FROM reach
), tied AS (
  SELECT node FROM ruled GROUP BY node
  HAVING bool_or(coalesce({_SQL_VERDICT} = 'block', false)) AND NOT bool_or(coalesce({_SQL_VERDICT} = 'allow', false))
), judged AS (
  SELECT page_id, {_sql_parts('url')[0]} AS host, {_sql_parts('url')[1]} AS path, {_sql_node('url')} AS node FROM pages
), with_rule AS (SELECT *, {_sql_rule('host', 'path')} AS rule FROM judged)
SELECT page_id, host, path, rule,
  coalesce({_SQL_VERDICT}, CASE WHEN tied.node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN tied.node IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM with_rule LEFT JOIN tied ON with_rule.node = tied.node
"""
