"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import blocks, byte_set, draw_rows, fold, keep_rows, lower_table, run_hashes, runs, small_batches, table

FOLDS, HELD_OUT = 5, 0
#: labelled documents of each label that vote, on average
PER_LABEL = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3

#: similarity is raised to this power to be a vote's weight
_SHARPNESS = 8
_WORDS = 1024
_BLOCK, _BLOCK_ROWS = 1 << 19, 512


def _byte_classes() -> tuple[np.ndarray, int]:
    """Class of each byte: small letter, capital, digit, blank, line end, beyond ASCII, or itself."""
    t = np.zeros(256, np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 4
    t[[32, 9, 11, 12]], t[[10, 13]] = 5, 6
    own = [c for c in range(33, 127) if not chr(c).isalnum()]
    t[own] = np.arange(7, 7 + len(own))
    return t, 7 + len(own)


_CLASS, _CLASSES = _byte_classes()
_BLANK = byte_set(range(9, 14), 32)
_LOWER = lower_table()
_PAIRS = _CLASSES * _CLASSES
#: terms: pairs of byte classes, hashed words, words equal to the one before, words used before
TERMS = _PAIRS + _WORDS + 2


def term_shares(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the terms in each row's text; zero for an empty text."""
    rows = len(starts) - 1
    out = np.zeros((rows, TERMS), np.float32)
    if not len(data):
        return out
    owner = np.repeat(np.arange(rows), np.diff(starts))
    kind = _CLASS[data]
    same = owner[1:] == owner[:-1]
    pair = (owner[:-1] * _PAIRS + kind[:-1] * _CLASSES + kind[1:])[same]
    out[:, :_PAIRS] = np.bincount(pair, minlength=rows * _PAIRS).reshape(rows, _PAIRS)
    begin, end, per_row = runs(~_BLANK[data], starts)
    word_owner = np.repeat(np.arange(rows), per_row)
    words = run_hashes(_LOWER[data], begin, end)
    out[:, _PAIRS:_PAIRS + _WORDS] = np.bincount(
        word_owner * _WORDS + (words % np.uint64(_WORDS)).astype(np.int64), minlength=rows * _WORDS
    ).reshape(rows, _WORDS)
    total = np.maximum(per_row, 1)
    again = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    # a few words repeated by chance are no repetition
    chance = total + 8
    repeated = np.bincount(word_owner[1:][again], minlength=rows) / chance
    order = np.lexsort((words, word_owner))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
    used_before = (per_row - np.bincount(word_owner[order][new], minlength=rows)) / chance
    out[:, :_PAIRS] /= np.maximum(out[:, :_PAIRS].sum(1, keepdims=True), 1)
    out[:, _PAIRS:_PAIRS + _WORDS] /= 4 * total[:, None]
    out[:, -2], out[:, -1] = repeated, used_before / 4
    return np.sqrt(out)


@dataclass
class Model:
    basis: np.ndarray  # term by latent dimension, weighted by inverse document frequency
    vectors: np.ndarray  # labelled rows, of length one
    labels: np.ndarray
    prior: float  # share of label 1 among all labelled rows, for texts that are like none

    def score(self, shares: np.ndarray, neighbours: int) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(shares), self.prior)
        similar = _unit(shares @ self.basis) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(similar, len(self.labels) - k, axis=1)[:, len(self.labels) - k:]
        weight = np.maximum(np.take_along_axis(similar, near, 1), 0).astype(np.float64) ** _SHARPNESS
        total = weight.sum(1)
        votes = (weight * self.labels[near]).sum(1)
        return np.where(total > 0, np.clip(votes / np.where(total > 0, total, 1), 0, 1), self.prior)


    def score_texts(self, texts: pa.Array, neighbours: int) -> np.ndarray:
        parts = [self.score(term_shares(data, starts), neighbours) for _, _, data, starts in blocks(texts, _BLOCK, _BLOCK_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _latent(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by randomised subspace iteration."""
    q = np.random.default_rng(3).standard_normal((x.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions]


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, starts in blocks(batch.column("text"), _BLOCK, _BLOCK_ROWS):
            x = term_shares(data, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw")[row:end], batch.column("quality")[row:end], pa.array([r.tobytes() for r in x], pa.binary())],
                ["draw", "quality", "shares"],
            )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, dimensions: int = DIMENSIONS) -> Model:
    """A model of about ``per_label`` documents of each label, drawn by a hash of the id and then of id and text.

    ``labels`` holds doc_id and quality, 0 or 1; other values and ids without a document teach
    nothing. Rows equal in id and text are one, and an id of very many rows brings no more than other drawn
    ones together. The drawn documents, a bounded number, are what the driver gets of the corpus.
    """
    small_batches(docs.sparkSession)
    labels = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").distinct()
    counts = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("quality") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    drawn = labels.where(draw < share).withColumn("quality", F.col("quality").cast("int"))
    # at most about two times per_label ids, of which each may have any number of rows
    labelled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = draw_rows(labelled, "quality", 2 * per_label).mapInArrow(_shares, "draw long, quality int, shares binary").toArrow()
    n = rows.num_rows
    if not n:
        return Model(np.zeros((TERMS, 0)), np.zeros((0, 0)), np.zeros(0), prior)
    x = np.frombuffer(b"".join(rows.column("shares").to_pylist()), np.float32).reshape(n, TERMS)
    # the same order in every run, whatever order the tasks end in
    order = np.lexsort(np.array([rows.column("quality").to_numpy(), rows.column("draw").to_numpy()]))
    x = x[order]
    idf = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = x * idf
    basis = _latent(x, min(dimensions, n))
    return Model(
        (idf[:, None] * basis).astype(np.float32), _unit(x @ basis).astype(np.float32),
        rows.column("quality").to_numpy()[order].astype(np.float64), prior,
    )


def score_quality(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: more like label 1) and predicted (score >= threshold) of every row.

    A text's vector is compared with all voting vectors, block by block; its nearest ``neighbours``
    vote with the similarity as weight. NULL and empty texts are like none and score the share of
    label 1 among the labelled rows, as do all texts if there are none (then 0.5). Repeated rows
    score alike. Columns other than doc_id and text are ignored. No documents, no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms by dimensions, voters by dimensions

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score_texts(batch.column("text"), neighbours)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all columns, that ``score_quality`` predicts as 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda batch: shared.value.score_texts(batch.column("text"), neighbours) >= threshold)


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels outside the held-out fold."""
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    scored = score_quality(docs, fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
