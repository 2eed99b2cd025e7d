"""Language identification by sparse multinomial logistic regression on character n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import draw_rows, fold, keep_rows, small_batches, strings, table

#: features; n-grams are hashed into them
FEATURES = 1 << 15
NGRAMS = (1, 2, 3)
#: labelled documents of each language the model is fitted on, on average, and of all languages
PER_LANGUAGE, MOST_ROWS = 600, 40_000
#: languages that are learnt, the most frequent ones; the weights of more would not fit a worker
MOST_LANGUAGES = 256
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

_EPOCHS, _ALPHA, _BETA, _L1, _L2 = 3, 0.5, 1.0, 0.02, 0.002
_SCALE = 20.0
#: of the least share of known letters among the texts kept for calibration
_MARGIN = 0.25
_CHARS = 1 << 19

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, letters and blanks as code points, row starts, whether a row has a letter)."""
    row = 0
    while row < len(texts):
        part, size = [], 0
        while row + len(part) < len(texts) and (not part or size < _CHARS):
            # a blank before and after marks where words begin and end
            part.append(f" {texts[row + len(part)].lower()} ")
            size += len(part[-1])
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter_table()[codes]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in part])])
        yield row, np.where(letter, codes, np.uint32(32)), starts, np.logical_or.reduceat(letter, starts[:-1])
        row += len(part)


def _features(codes: np.ndarray, n: int) -> np.ndarray:
    """The feature of the n-gram that begins at each position."""
    x = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(FEATURES)).astype(np.int64)


def _grams(n_chars: np.ndarray) -> np.ndarray:
    """How many n-grams a row of so many characters has."""
    return sum(np.maximum(n_chars - n + 1, 0) for n in NGRAMS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature by language, with the inverse document frequency and scale in it
    bias: np.ndarray
    temperature: float
    letters: np.ndarray  # feature by language: whether learnt texts in it hold that letter
    least_known: float  # a text that shares fewer of its letters with those of its language is not in it

    def known_letters(self, texts: list[str], names: list[str]) -> np.ndarray:
        """The share of each text's letters that learnt texts in the named language hold too; 0 without letters or language."""
        out = np.zeros(len(texts))
        place = {name: k for k, name in enumerate(self.languages)}
        for row, codes, starts, has in _blocks(texts):
            for i in np.flatnonzero(has):
                own = codes[starts[i]:starts[i + 1]]
                own = own[own != 32]
                if names[row + i] in place:
                    out[row + i] = self.letters[_features(own, 1), place[names[row + i]]].mean()
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for row, codes, starts, known in _blocks(texts):
            logits = np.zeros((len(starts) - 1, len(self.languages)))
            for n in NGRAMS:
                if len(codes) < n:
                    continue
                features = _features(codes, n)
                begin = np.minimum(starts[:-1], len(features))
                end = np.clip(starts[1:] - n + 1, begin, len(features))
                for k in range(len(self.languages)):
                    total = np.concatenate([[0.0], np.cumsum(self.weights[:, k][features], dtype=np.float64)])
                    logits[:, k] += total[end] - total[begin]
            logits = logits / np.maximum(_grams(np.diff(starts)), 1)[:, None] + self.bias
            p = np.exp((logits - logits.max(1, keepdims=True)) / self.temperature)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i in np.flatnonzero(known):
                names[row + i] = self.languages[best[i]]
                scores[row + i] = min(1.0, p[i, best[i]])
        return names, scores


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, letters, letter_counts = [], [], [], []
        for _, codes, starts, _ in _blocks(strings(batch.column("text"))):
            for i in range(len(starts) - 1):
                own = codes[starts[i]:starts[i + 1]]
                found = np.concatenate([_features(own, n) for n in NGRAMS if len(own) >= n])
                j, c = np.unique(found, return_counts=True)
                ids.append(j.astype(np.int32))
                counts.append((c / len(found)).astype(np.float32))
                j, c = np.unique(_features(own[own != 32], 1), return_counts=True)
                letters.append(j.astype(np.int32))
                letter_counts.append((c / max(c.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("lang"), *(
                pa.array(x, pa.list_(k)) for x, k in ((ids, pa.int32()), (counts, pa.float32()), (letters, pa.int32()), (letter_counts, pa.float32()))
            )],
            ["draw", "lang", "ids", "shares", "letters", "letter_shares"],
        )


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from about ``per_language`` of the different rows of each ``lang``; rows without one teach nothing.

    Of more than ``MOST_LANGUAGES`` languages the most frequent are learnt, of equally frequent ones the first by name;
    all together bring about ``MOST_ROWS`` rows at most. Rows are drawn by a hash of id and text, equal ones are one.
    Follow-the-regularised-leader with elastic-net penalties passes over four fifths of the sample;
    the last fifth sets the temperature and the share of letters that a text in a learnt language has to
    share with others in it. The sample is what the driver gets of the documents.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text").where("lang is not null")
    learnt = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    docs = docs.where(F.col("lang").isin([r.lang for r in learnt]))
    per_language = min(per_language, MOST_ROWS // max(len(learnt), 1))
    rows = draw_rows(docs, "lang", per_language).mapInArrow(
        _vectors, "draw long, lang string, ids array<int>, shares array<float>, letters array<int>, letter_shares array<float>"
    ).toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0), 1.0, np.zeros((FEATURES, 0), bool), 0.0)
    order = np.random.default_rng(5).permutation(np.lexsort((rows["lang"], rows["draw"])))
    ids = [np.array(rows["ids"][i]) for i in order]
    target = np.array([languages.index(rows["lang"][i]) for i in order])
    seen = np.zeros(FEATURES)
    for j in ids:
        seen[j] += 1
    idf = np.log((1 + len(ids)) / (1 + seen)) + 1
    values = [np.array(rows["shares"][i]) * idf[j] * _SCALE for i, j in zip(order, ids, strict=True)]
    n_fit = max(1, len(ids) * 4 // 5)

    z, n = np.zeros((FEATURES, len(languages))), np.zeros((FEATURES, len(languages)))
    bias = np.zeros(len(languages))
    bias_n = np.full(len(languages), 1.0)

    def weights(j=slice(None)):
        zj, nj = z[j], n[j]
        shrunk = np.sign(zj) * np.maximum(np.abs(zj) - _L1, 0)
        return -shrunk / ((_BETA + np.sqrt(nj)) / _ALPHA + _L2)

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for _ in range(_EPOCHS):
        for i in range(n_fit):
            j, x = ids[i], values[i]
            w = weights(j)
            error = softmax(x @ w + bias)
            error[target[i]] -= 1
            g = x[:, None] * error
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / _ALPHA * w
            n[j] += g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    w = weights()
    check = range(n_fit, len(ids)) if n_fit < len(ids) else range(len(ids))
    logits = np.array([values[i] @ w[ids[i]] + bias for i in check])
    logits -= logits.max(1, keepdims=True)

    def loss(t):
        x = logits / t
        return float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), target[list(check)]]))

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    letters = np.zeros((FEATURES, len(languages)), bool)
    for k, i in enumerate(order[:n_fit]):
        letters[rows["letters"][i], target[k]] = True
    shares = [
        float(np.dot(rows["letter_shares"][order[k]], letters[rows["letters"][order[k]], target[k]])) for k in check if rows["letters"][order[k]]
    ]
    return Model(
        languages, (w * idf[:, None] * _SCALE).astype(np.float32), bias, float(temperature), letters, min(shares, default=0.0) * _MARGIN
    )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, the calibrated probability, of every row, from the whole text.

    NULL and texts without a letter are ``und`` with score 0, as all are if nothing could be learnt.
    Repeated rows are scored alike. Columns other than doc_id and text are ignored. No rows, no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features by languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all columns, that ``identify`` gives a language which they are written in.

    A text that is split between languages stays, however little probable the best one is. One goes if it is ``und``
    or shares fewer of its letters with the learnt texts in its language than ``least_known``, a quarter of the least
    that any labelled text kept for calibration shares with its own. All stay if nothing could be learnt.
    """
    if not model.letters.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(batch: pa.RecordBatch) -> np.ndarray:
        texts = strings(batch.column("text"))
        names, _ = shared.value.predict(texts)
        known = shared.value.known_letters(texts, names)
        return (known > 0) & (known >= shared.value.least_known)

    return keep_rows(docs, identified)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows outside the held-out fold."""
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    found = identify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(table(spark, sf_dir, "documents"))
