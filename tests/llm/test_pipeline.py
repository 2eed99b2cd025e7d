"""Each stage of the pipeline against a plain computation over its own input."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evalgrid.llm import decontamination, language_id, quality
from tests.llm.test_decontamination import brute_force as contamination
from tests.llm.test_near_duplicates import brute_force as duplicates
from tests.llm.test_packing import _check

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """What each stage got and gave."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((docs, after))
        docs = after
    return out


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing",
    ]
    for _, after in outputs[:-1]:
        assert after.columns == COLUMNS


def test_quality(spark, outputs):
    before, after = outputs[0]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.select("doc_id", "text").collect()
    scores = model.score_texts(pa.array([r.text for r in rows], pa.string()), quality.NEIGHBOURS)
    assert set(_by_id(after)) == {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= 0.3}
    assert 0 < after.count() < before.count()


def test_language(outputs):
    before, after = outputs[1]
    # every text of the table that has a letter is in one of its languages
    kept = {r.doc_id for r in before.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}
    assert set(_by_id(after)) == kept


def test_near_duplicates(outputs):
    before, after = outputs[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    expected = {class_id for _, class_id, _ in duplicates(rows)}
    assert set(_by_id(after)) == expected and after.count() == len(expected) < len(rows)


def test_decontamination(spark, outputs):
    before, after = outputs[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    old, new = _by_id(before), _by_id(after)
    assert set(old) == set(new)
    hit = {doc_id: n_hit for doc_id, _, n_hit, *_ in contamination([(r.doc_id, r.text) for r in old.values()], items)}
    words = lambda t: len(decontamination._words(*_bytes(t))[0])
    for i, r in new.items():
        assert (r.text == old[i].text) == (hit[i] == 0)
        assert words(old[i].text) - words(r.text) == hit[i] and r.n_chars == len(r.text)
    assert any(hit.values())


def _bytes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_packing(outputs):
    before, after = outputs[4]
    rows = before.orderBy("doc_id").collect()
    number = {r.doc_id: i for i, r in enumerate(rows)}
    pieces = [r.asDict() | {"doc_id": number[r.doc_id]} for r in after.collect()]
    from pyspark.sql import Row

    used = _check([Row(**p) for p in pieces], [r.text for r in rows], 2048)
    n = sum(len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(r.text).ids) + 1 for r in rows)
    assert used <= -(-n // 2048) + 2


def test_run_gives_the_last_stage(spark, outputs):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    found = corpus_pipeline.run(spark, SF).select(*key).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, outputs[-1][1].select(*key).collect()))


def test_odd_rows_pass_each_stage(spark, tmp_path):
    """NULLs, repeated rows, clashing names, long and empty texts, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, one int, spans int, score string, quality int"
    extra = ("k", 1, 2, "s", 3)
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs far away", "en", "s", 10, *extra) for i in range(30)]
    rows += [(40, None, None, None, None, *extra), (None, "alone and without any id in here", "en", None, 5, *extra), (41, "", "de", "", 0, *extra)]
    rows += [(42, "der schnelle braune fuchs springt " * 4000, "de", "s", 1, *extra)] + [(50, "the same text twice in the table", "en", "s", 1, *extra)] * 3
    docs = spark.createDataFrame(rows, schema)
    (tmp_path / "x").mkdir()
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 0), (50, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        now = frame
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if i < 4:
                assert now.columns == docs.columns and now.dtypes == docs.dtypes
            if i == 2 and frame is docs:
                assert now.where("doc_id = 50").count() == 1
            if i == 3 and frame is docs:
                assert now.where("text like '%quick brown fox%'").count() == 0
        assert (now.count() > 0) == (frame is docs)
