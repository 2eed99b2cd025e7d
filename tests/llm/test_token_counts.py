from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalgrid.llm import token_counts

PATH = public_tokenizers.path(token_counts.TOKENIZER)


def _check(spark, texts, **kwargs):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH, **kwargs).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert found[i].n_tokens == n, t
        assert found[i].n_bytes == len((t or "").encode())
        assert found[i].over_limit == (n > kwargs.get("limit", token_counts.LIMIT))


def test_equal_to_the_library(spark):
    texts = [
        None, "", " \n\t ", "Hello, World's it's  'S end", "ΣΟΦΟΣ ΑΣ Σ, İstanbul ﬁ", "é ́ a b c\x1cd\x85e",
        "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000, "wort " * 3000, "中文 字。Ünï 123 4.5", "🙂🙂 a🙂", "a" * 70 + " b",
        "same", "same",
    ]
    _check(spark, texts)
    _check(spark, texts, limit=2, table_rows=3)


def test_small_cache(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "_CACHE_ROWS", 2)
    _check(spark, ["one two three", "four five six seven", "one two eight"], table_rows=1)


def test_table_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _check(spark, [r.text for r in docs.select("text").collect()])


def test_frequent_pretokens_of_a_table(spark):
    """The summaries of many tasks, merged in steps, hold what counting everything finds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = [w for r in docs.select("text").collect() for w in (r.text or "").encode().split() if len(w) <= 64]
    counts = Counter(w.lower() if w.isascii() else w for w in pieces)
    best = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    whole = token_counts.frequent_pretokens(docs.repartition(20))
    assert len(whole) == min(len(best), token_counts.TABLE_ROWS)
    assert sum(counts[w] for w in whole) >= 0.99 * sum(counts[w] for w in best[:len(whole)])
    assert token_counts.frequent_pretokens(docs.repartition(3), 10)[:3] == best[:3]


def test_a_summary_falls_short_by_its_bound(monkeypatch, spark):
    monkeypatch.setattr(token_counts, "_LEAST_ROOM", 0)
    texts = [" ".join(["often"] * 30 + ["next"] * 20 + [f"w{i}x{k}" for k in range(40)]) for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    assert token_counts.frequent_pretokens(docs, 5)[:2] == [b"often", b"next"]
    cut = token_counts._cut({b"a": 9, b"b": 5, b"c": 5, b"d": 1}, 2)
    assert cut == {b"a": 4}


@pytest.mark.parametrize("rows", [0, 1])
def test_no_rows(spark, rows):
    docs = spark.createDataFrame([(None, None)][:rows], "doc_id long, text string")
    assert token_counts.count_tokens(docs, PATH).count() == rows


def test_letters_that_compose_in_lower_case_only(spark):
    texts = ["J̌", "aJ̌b THE", "Ä ABC", "T̈ x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()} == expected
