import duckdb

from evalgrid.llm import url_filter
from evalgrid.llm.components import connected_components

SCHEMA = "page_id long, url string, html string"


def _link(href):
    return f'<html><head><link href="{href}" rel="canonical"></head></html>'


def _moved(href):
    return f"<meta content='0; URL={href}' http-equiv=refresh>"


PAGES = [
    (1, "http://a.example.org/x", _link("https://b.net/y")),  # alias of a blocked address
    (2, "http://c.example.org/z?q=1#top", _moved("http://a.example.org/x")),  # two steps away
    (3, "https://b.net/y#f", ""),
    (4, "http://www.org/fr/1", _link("http://b.net/w")),  # own rule allows
    (5, "http://d.example.org/", _link("http://b.net/w")),  # tied to an allowed and a blocked one
    (6, "http://x.example.net/en/5", None),
    (7, "http://x.example.net/de/5", None),
    (8, "http://net", ""),  # path is empty, the rule wants a slash
    (9, None, None),
    (10, "no address", _link("http://b.net/y")),
    (11, "http://E.Example.COM/de/1", "<!-- " + _link("http://a.org/") + " -->"),
    (12, "http://f.example.org/dir/page", _link("../x")),
    (13, "http://g.example.org/dir/page", _link("/other")),
    (13, "http://g.example.org/dir/page", _link("/other")),
    (14, "http://g.example.org/other", _link("//b.net/q")),
    (15, "http://notnet/en/", ""),
    (16, "http://h.example.org/" + "a" * 20000, _link("http://b.net/y")),
]
BLOCKED_BY_ALIAS = {1, 2, 13, 14, 16}


def test_verdicts(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], SCHEMA + ", rule string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id for r in rows if r.by == "alias"} == BLOCKED_BY_ALIAS
    by_id = {r.page_id: r for r in rows}
    assert by_id[3].rule == "net/" and by_id[3].verdict == "block" and by_id[3].path == "/y"
    assert by_id[4].verdict == "allow" and by_id[4].rule == "org/fr/"
    assert by_id[5].verdict == "allow" and by_id[5].rule is None
    assert by_id[6].rule == "example.net/en/" and by_id[7].rule == "net/"
    assert by_id[8].rule is None and by_id[8].host == "net" and by_id[8].path == ""
    assert by_id[9].host == "" and by_id[9].verdict == "allow" and by_id[10].verdict == "allow"
    assert by_id[11].host == "e.example.com" and by_id[11].rule == "example.com/de/"
    assert by_id[15].rule is None


def test_sql_agrees(spark, tmp_path):
    spark.createDataFrame(PAGES, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    expected = con.execute(url_filter.SQL).fetchall()
    found = url_filter.op10_url_filter(spark, str(tmp_path)).collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found)


def test_empty(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_hubs_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 600)] + [(7, 3), (3, 5), (5, 7), (9, 9)]
    edges += [(None, 3), (3, None), (7, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[x] for x in range(100, 141)} == {100}
    assert {found[x] for x in range(500, 600)} == {500}
    assert {found[x] for x in (3, 5, 7)} == {3} and 9 not in found


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    plan = url_filter.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
