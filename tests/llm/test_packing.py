import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalgrid.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = [
    None, "", " ", "a", "Foo bar's, baz.\n\nQux  quux   x\t y \n z ", "  lead", "trail  ", "\n \n a", "é ́ a b\x1c c\x85 d",
    "x <|endoftext|> y<|endoftext|>", "中文 字。 🙂 🙂🙂", "long " * 5000, "w" * 9000, "same", "same", "12 345 6789 ' s 't it's",
]


def _ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def _check(rows, texts, length):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids, at = _ids(tokenizer, text), 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert r.piece == k and r.start == at and 0 < r.length <= length
            assert k == 0 or r.length == length
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence)


def test_pieces_are_those_of_the_library(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    for length in (2048, 5):
        rows = packing.pack_documents(docs, PATH, length).collect()
        _check(rows, TEXTS, length)


def test_table_is_packed_without_waste(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = packing.op9_best_two_fit(spark, "/root/testdata/sf0.001").collect()
    used = _check(rows, texts, packing.LENGTH)
    assert used <= -(-sum(r.length for r in rows) // packing.LENGTH) + 1


def test_packing_in_turns(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACKED_AT_ONCE", 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    _check(packing.pack_documents(docs, PATH, 64).collect(), TEXTS, 64)


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_two_pieces_replace_one():
    # greedy takes 6 and 3 and leaves a gap of 1; 2 and 2 in place of 3 leave none
    bins, offsets, number = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0] and number == 2


def plain_best_two_fit(lengths, room):
    """The lengths in each bin, by looking at all pieces and all pairs."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        chosen, gap = [], room
        while fitting := [x for x in left if x <= gap]:
            chosen.append(fitting[0])
            left.remove(fitting[0])
            gap -= fitting[0]
        if gap and len(chosen) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1:] if chosen[-1] < a + b <= gap + chosen[-1]]
            if pairs:
                _, *pair = max(pairs)
                for x in pair:
                    left.remove(x)
                left = sorted([*left, chosen[-1]], reverse=True)
                chosen[-1:] = pair
        bins.append(chosen)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 90))
def test_bins_are_those_of_a_plain_search(lengths, room):
    bins, _, number = packing.best_two_fit(np.array(lengths, np.int64), room)
    held = [[] for _ in range(number)]
    for b, n in zip(bins.tolist(), lengths, strict=True):
        held[b].append(n)
    assert [sorted(x) for x in held] == [sorted(x) for x in plain_best_two_fit(lengths, room)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_bins_hold_each_piece_once(lengths):
    bins, offsets, number = packing.best_two_fit(np.array(lengths, np.int64), 40)
    taken = sorted((b, o, n) for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths, strict=True))
    at, before = 0, -1
    for b, o, n in taken:
        at = 0 if b != before else at
        assert o == at
        at, before = o + n, b
        assert at <= 40
    assert set(bins.tolist()) == set(range(number))
    # any two neighbouring bins hold more than one bin's room, as a later one's pieces did not fit
    assert number <= max(1, -(-2 * sum(lengths) // 40))
