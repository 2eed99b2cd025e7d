import zlib

import numpy as np

from evalgrid.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = quality.op2_quality(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.95 * len(held)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 3.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")


def test_odd_texts_and_labels(spark):
    texts = ["The cat sat on the mat, and so did the dog."] * 30 + ["BUY!! BUY!! BUY!! NOW!!"] * 30
    texts += [None, "", "  ", "NOW!! BUY!! " * 30000, "x"]
    labels = [(i, int(i < 30)) for i in range(60)] * 2 + [(61, None), (None, 1), (999, 0), (3, 7)]
    labels = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.learn_and_score(_docs(spark, texts), labels).collect()}
    assert len(found) == len(texts)
    assert found[0].score > 0.9 and found[40].score < 0.1 and found[63].score < 0.1
    assert found[60].score == found[61].score and 0 < found[60].score < 1


def test_one_label_none_and_no_documents(spark):
    docs = _docs(spark, ["good text here", "more text"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.learn_and_score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality.learn_and_score(docs, one).collect()} == {1}
    assert quality.learn_and_score(docs.limit(0), one).count() == 0


def test_voters_are_bounded_by_rows(spark):
    # one labelled id holds a third of the rows, each with its own text
    texts = [(5, f"The cat sat on mat {i}.", 1.0) for i in range(500)] + [(100 + i, f"BUY!! NOW!! {i}", 1.0) for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(5, 1)] + [(100 + i, 0) for i in range(1000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_label=50)
    assert 50 <= (model.labels == 1).sum() < 150 and 20 < (model.labels == 0).sum() < 90


def test_votes_against_brute_force(spark):
    """Scores of all texts as a plain loop over all voters gives them."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, per_label=200)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    for r in docs.where("doc_id % 9 = 0").collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        vector = (quality.term_shares(data, np.array([0, len(data)]))[0].astype(np.float64) @ model.basis.astype(np.float64))
        length = float(np.sqrt(vector @ vector))
        near = sorted(((float(v @ vector) / max(length, 1e-12), y) for v, y in zip(model.vectors.astype(np.float64), model.labels, strict=True)), reverse=True)
        votes = [(max(c, 0.0) ** 8, y) for c, y in near[:quality.NEIGHBOURS]]
        total = sum(w for w, _ in votes)
        expected = sum(w * y for w, y in votes) / total if total else model.prior
        assert abs(found[r.doc_id].score - expected) < 0.02
