import hashlib
import random
import re

from evalgrid.llm import near_duplicates as N

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _set(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows):
    sets = [_set(t) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) * 5 >= 4 * len(a | b)] for i, a in enumerate(sets)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = set(links[todo.pop()]) - group
                group |= new
                todo += new
            for j in group:
                seen[j] = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
    return sorted(((rows[i][0], seen[i], len(links[i])) for i in range(len(rows))), key=str)


def _found(spark, rows, **kwargs):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_links int")
    return sorted((tuple(r) for r in N.join_similar(docs, **kwargs).collect()), key=str)


def _texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 200))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = list(enumerate(_texts(1)))
    assert _found(spark, rows) == brute_force(rows)


def test_groups_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_TEXTS", 3)
    rows = list(enumerate(_texts(2)))
    assert _found(spark, rows) == brute_force(rows)


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in N.op8_jaccard_join(spark, sf).collect()), key=str) == brute_force(rows)


def test_odd_texts(spark):
    long = " ".join(f"word{i}" for i in range(20000))
    rows = [
        (1, None), (2, None), (3, ""), (4, " !! "), (5, "one two"), (6, "One, two!"), (7, "one two three"), (8, long), (9, long + " more"),
        (None, "same words in this text here"), (10, "same words in this text here"), (11, "same words in this text here"),
        (11, "same words in this text here"), (None, "alone in the world of texts"), (None, "alone in the world of texts"),
    ]
    assert _found(spark, rows) == brute_force(rows)
    assert _found(spark, []) == []


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99), (1.0, 0.9)):
        bands, rows = N.bands_and_rows(similarity, recall)
        assert bands * rows <= N.HASHES and 1 - (1 - similarity**rows) ** bands >= recall - 1e-9


def test_one_row_of_each_class_is_kept(spark):
    rnd = random.Random(5)
    rows = list(enumerate(_texts(3)))
    # copies of one text are a third of all rows, some of one id, and texts without words are many
    rows += [(500 + i % 20, rows[0][1]) for i in range(200)] + [(None, rows[0][1])] * 20 + [(900, "")] * 30 + [(None, None)] * 30
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, text_key int").repartition(4)
    kept = N.keep_one(docs)
    assert kept.schema == docs.schema
    wordless = [r for r in rows if not r[1]]
    worded = [r for r in rows if r[1]]
    classes = {}
    for (doc_id, text), (_, class_id, links) in zip(sorted(worded, key=str), sorted(brute_force(worded), key=str), strict=True):
        classes.setdefault(class_id if links else (doc_id, text), []).append((doc_id is None, doc_id, text))
    expected = [min(c, key=lambda r: (r[0], r[1] or 0, hashlib.md5(r[2].encode()).hexdigest()))[1:] for c in classes.values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected + wordless, key=str)
