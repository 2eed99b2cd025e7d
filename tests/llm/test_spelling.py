import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import spelling as S


def one_edit(a, b):
    """By trying the edits."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def counted(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(n):
    rows = {}
    for w in n:
        close = [x for x in n if x != w and one_edit(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        rows[w] = [form, None, n[w], len(close), n[form] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in rows.items())


def _words(seed, size, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(size)}
    return {w: rng.choice([3, 3, 4, 6, 7, 12, 30, 60, 500]) for w in words}


def _found(spark, n, **kwargs):
    frame = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, form string")
    return sorted(map(tuple, S.group_variants(frame, **kwargs).collect()))


@pytest.mark.parametrize("block", [3, 16, 512])
def test_equals_brute_force(spark, block):
    n = _words(block, 400) | {"Zebra"[1:] + "aa": 5, "grüßen": 9, "grussen": 40, "grussens": 100, "a" * 300: 4, "a" * 301: 8}
    assert _found(spark, n, block=block) == grouped(n)


def test_a_tile_with_a_large_share_of_the_words(spark):
    n = {f"station{a}{b}": 3 + (i * 7) % 90 for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrs")}
    n |= _words(8, 150)
    assert _found(spark, n, block=20) == grouped(n)


def test_long_chains(spark):
    n = {"a" * (5 + i): 3 * 2 ** i for i in range(30)}
    found = _found(spark, n)
    assert found == grouped(n)
    assert {r[2] for r in found} == {"a" * 34}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=4, max_size=7), min_size=2, max_size=12))
def test_each_pair_is_near_in_one_tile(words):
    words = sorted(words)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            seen = 0
            longer = max(len(a), len(b))
            for side in ("prefix", "suffix"):
                if min(len(a), len(b)) >= longer - 1:
                    held = S._Words([a, b], [1, 1], longer)
                    seen += int(S.near(held, held, longer, side)[0, 1])
            assert seen == one_edit(a, b)


def test_words_of_documents(spark):
    docs = [
        (1, None), (2, ""), (3, "Straße STRASSE straße ×÷ école École"), (None, "number numbers " * 4), (4, "x" * 30_000),
        (4, "word1word2 don't naïve naïve naïve"), (4, "word1word2 don't naïve naïve naïve"), (5, "ŁódŹ ΑΒΓ"),
    ]
    docs += [(i, "alphabet alphabets betas number Numbers zzzzz") for i in range(300)]
    frame = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n long, word string")
    expected = counted(docs)
    assert {r.word: r.n for r in S.count_words(frame).collect()} == expected
    assert any(w not in "alphabet alphabets betas number numbers zzzzz" for w in expected)  # some are damaged
    assert S.group_variants(S.count_words(frame.limit(0))).count() == 0


def test_table_of_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    n = counted(docs)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    found = sorted(map(tuple, S.op12_prefix_suffix_tiles(spark, path).collect()))
    assert {r[0]: r[3] for r in found} == n
    sample = found[::37]
    for word, form, root, k, n_near, form_n in sample:
        close = [x for m in (-1, 0, 1) for x in by_length.get(len(word) + m, []) if x != word and one_edit(word, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        assert n_near == len(close)
        assert form == (best if best and n[best] >= 2 * k else None)
        assert form_n == (n[form] if form else None)
