import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import decontamination as D
from evalgrid.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").encode().lower())


def brute_force(docs, items):
    windows = []
    for item, text in items:
        w = _words(text)
        windows += [(str(item), w[i:i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    out = []
    for doc_id, text in docs:
        w, hit, ids = _words(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Kurz, aber GUT"), (12, "kurz aber gut"),
    (3, None), (4, " ... "), (5, "a a a a a a a a a a a a"), (6, "ten eleven twelve one two three four five six seven eight"),
    (7, "größe ändert ÄNDERT"), (8, "a"), (8, "b c"),
]
DOCS = [
    (1, "x one two three four five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "kurz, aber\ngut! kurz aber gut"),
    (5, "one two three four five six seven eight nine"), (6, "a " * 40), (7, "b c"), (7, "b c"),
    (8, "größe ändert ändert ÄNDERT größe ändert ÄNDERT"),
    (9, "one two three four five six seven eight nine ten eleven twelve one two three four five six seven eight"),
    (10, ("filler words " * 3000) + "kurz aber gut " * 3000), (None, "kurz aber gut"), (11, "kurz aber gute"),
]


def _frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_words int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def _found(docs, items, **kwargs):
    return sorted((tuple(r) for r in D.report(D.find_contamination(docs, items, **kwargs)).collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = _frames(spark)
    assert _found(docs, items) == brute_force(DOCS, ITEMS)


def test_benchmark_in_parts_and_small_shards(spark, monkeypatch):
    docs, items = _frames(spark)
    assert _found(docs, items, part_chars=40) == brute_force(DOCS, ITEMS)


def test_a_task_holds_one_part(spark):
    docs, items = _frames(spark)
    # one item is nearly all of the benchmark
    items = items.unionByName(spark.createDataFrame([(77777, " ".join(f"q{i}" for i in range(3000)))], "item_id long, text string"), True)
    found = D.find_contamination(docs, items, part_chars=6000)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((tuple(r) for r in D.report(found).collect()), key=str) == brute_force(DOCS, ITEMS)


def test_sql_agrees(spark, tmp_path):
    docs, items = _frames(spark)
    docs.drop("n_words").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    expected = sorted(con.execute(f"SELECT {columns} FROM ({D.SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in D.op6_decontamination(spark, str(tmp_path)).collect()), key=str) == expected


def test_spans_are_cut_out(spark):
    docs, items = _frames(spark)
    cut = {r.doc_id: r.text for r in D.without_spans(D.find_contamination(docs, items)).collect()}
    assert cut[1] == "x  y" and cut[4] == ""
    assert cut[2] is None and cut[11] == "kurz aber gute" and "kurz" not in cut[10]
    assert cut[8] == "größe ändert ändert ÄNDERT "


def test_empty_tables(spark):
    docs, items = _frames(spark)
    assert _found(docs.limit(0), items) == []
    assert _found(docs, items.limit(0)) == brute_force(DOCS, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.integers(1, 3), min_size=1, max_size=5))
def test_index_finds_each_occurrence(runs, phrase):
    symbols = np.array([x for run in runs for x in (*run, 0)])
    order = suffix_array(symbols)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    index = FMIndex(symbols, 3)
    low, high = index.ranges(np.array([[0] * (6 - len(phrase)) + phrase]), np.array([len(phrase)]))
    places = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    n = len(phrase)
    assert places == [i for i in range(len(symbols) - n + 1) if symbols[i:i + n].tolist() == phrase]
