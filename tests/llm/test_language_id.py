import zlib

from evalgrid.llm import language_id
from evalgrid.llm.common import draw_rows

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language_id.op5_language_id(spark, SF).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right > 0.97 * len(held)
    # calibrated: the mean score is about the accuracy
    assert abs(sum(r.score for r in held) / len(held) - right / len(held)) < 0.03


def test_odd_texts(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(40)] + [(100 + i, f"der hund und die katze {i}", "de") for i in range(40)]
    rows += [(200, "und der", None), (300, None, "en"), (301, "", "de"), (302, " 12 !! ", "en"), (303, "é", "en"), (None, "the dog", "en")]
    rows += [(304, "die katze " * 20000, None), (305, "x", None)] * 2
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    found = language_id.learn_and_identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[300].lang_pred == by_id[301].lang_pred == by_id[302].lang_pred == "und"
    assert by_id[304].lang_pred == "de" and by_id[None].lang_pred == "en"
    assert by_id[305].lang_pred in ("de", "en")


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    found = language_id.learn_and_identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    assert language_id.learn_and_identify(spark.createDataFrame([], schema)).count() == 0


def test_weights_are_sparse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    assert (model.weights == 0).mean() > 0.5


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_texts_in_no_learnt_language_go(spark):
    rows = [(i, f"the cat and the dog {'abcdefghij'[i % 10]}", "en") for i in range(60)]
    rows += [(100 + i, f"der hund und die katze {'abcdefghij'[i % 10]}", "de") for i in range(60)]
    rows += [(200 + i, t, None) for i, t in enumerate([
        "\u4e2d\u6587\u7684\u6587\u672c", "\u0440\u0443\u0441\u0441\u043a\u0438\u0439", None, "", "12 !!",
        "the dog und die katze", "the cat \u4e2d\u6587", "die", "der hund " * 5000,
    ])]
    docs = _texts(spark, rows).selectExpr("*", "0.5 as score", "lang as lang_pred")
    kept = language_id.keep_identified(docs, language_id.fit(docs))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60)) | set(range(100, 160)) | {205, 206, 207, 208}


def test_unlabelled_documents_teach_no_rejection(spark):
    docs = _texts(spark, [(1, "abc", None), (2, None, None)])
    assert language_id.keep_identified(docs, language_id.fit(docs)).count() == 2
    docs = _texts(spark, [(1, "abc", None), (2, "12", "en")])
    assert language_id.keep_identified(docs, language_id.fit(docs)).count() == 2


def test_samples_are_bounded_by_rows(spark):
    # a third of the rows has one id and as many texts, a third no id, a third is one text many times
    rows = [(7, f"text {i}", "en") for i in range(3000)] + [(None, f"text {i}", "en") for i in range(3000)] + [(8, "copy", "en")] * 3000
    drawn = draw_rows(_texts(spark, rows), "lang", 300).collect()
    assert 200 < len(drawn) < 400 and len({r.draw for r in drawn}) == len(drawn)
    everything = draw_rows(_texts(spark, rows), "lang", 100000)
    assert everything.count() == 6001
    assert draw_rows(_texts(spark, []), "lang", 5).count() == 0


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 3000)
    rows = [(i, f"word {i}", f"l{i:05d}") for i in range(10000)] + [(20000 + i, f"the dog {i}", "en") for i in range(50)]
    rows += [(21000 + i, f"der hund {i}", "de") for i in range(40)]
    model = language_id.fit(_texts(spark, rows))
    assert len(model.languages) <= language_id.MOST_LANGUAGES and {"en", "de", "l00000"} <= set(model.languages)
    assert "l09999" not in model.languages
