"""Spelling variant grouping: words one edit apart, found by dense prefix-suffix tiles."""

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import small_batches, strings, table
from evalgrid.session import materialise

#: code points a word has at least, and occurrences
SHORTEST, SELDOMEST = 5, 3
#: a form is at least so many times as frequent as its variant
MORE_FREQUENT = 2
#: one in so many words of a document loses a code point
DAMAGED = 97
#: words of a block; a tile with more is compared block by block
BLOCK = 512
#: words a task counts before it hands them on
_HELD = 300_000

_WORD = re.compile("[a-zÀ-ÿ]+")


def damaged_word(word: str, begin: int) -> str:
    """The word, without one code point if its hash says so; ``begin`` is the crc32 of what stands before it."""
    h = zlib.crc32(word.encode(), begin)
    if h % DAMAGED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: lower-cased (A-Z only) runs of Latin letters of all texts, damaged by document and word.

    Words of fewer than ``SHORTEST`` code points or ``SELDOMEST`` occurrences are left out. Tasks sum
    before the exchange. NULL texts have no words, a NULL id is empty text; repeated rows all count.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), strings(batch.column("text")), strict=True):
                begin = zlib.crc32(f"{doc}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(_WORD.findall(text.encode().lower().decode())).items():
                    word = damaged_word(word, begin)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) >= _HELD:
                    yield handed_on()
        if held:
            yield handed_on()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counts = texts.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SELDOMEST)


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of blocks that hold all words one edit apart: ``longer, side, whole, left, right``.

    If two words, the longer of L code points, differ by one edit, their common prefix and suffix
    have L - 1 code points, so one of them has L // 2 at least. Words of L or L - 1 code points that
    share that prefix, or that suffix, are a tile. A word is in four tiles. A tile is cut into
    blocks of about ``block`` words by a hash; ``right`` is NULL where a block meets itself, and
    ``whole`` tells that it is a tile that was not cut.
    """
    length = F.length("word")

    def tile(more: int, side: str):
        longer = (length + more).cast("int")
        half = F.floor(longer / 2).cast("int")
        text = F.left(F.col("word"), half) if side == "prefix" else F.right(F.col("word"), half)
        return F.struct(longer.alias("longer"), F.lit(side).alias("side"), text.alias("half"))

    places = F.explode(F.array(*(tile(more, side) for more in (0, 1) for side in ("prefix", "suffix"))))
    key = ["longer", "side", "half"]
    members = words.select("word", "n", places.alias("t")).select("t.*", "word", "n")
    large = members.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    blocks = (
        members.join(large, key, "left")
        .withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
        .groupBy(*key, "part")
        .agg(F.collect_list(F.struct("word", "n")).alias("left"), F.first(parts).alias("parts"))
    )
    alone = blocks.where("parts = 1 AND size(left) > 1").select("longer", "side", F.lit(True).alias("whole"), "left", F.lit(None).cast(blocks.schema["left"].dataType).alias("right"))
    cut = blocks.where("parts > 1")
    other = cut.select(*key, F.col("part").alias("other"), F.col("left").alias("right"))
    met = (
        cut.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
        .join(other, [*key, "other"])
        .select("longer", "side", F.lit(False).alias("whole"), "left", F.when(F.col("part") != F.col("other"), F.col("right")).alias("right"))
    )
    return alone.unionByName(met)


def _matrix(words: list[str], longer: int) -> np.ndarray:
    """Code points of the words, padded with 0."""
    return np.array(words, f"U{longer}").view(np.uint32).reshape(len(words), longer)


class _Words:
    """A block as two padded matrices, of the words and of the words backwards."""

    def __init__(self, words: list[str], n: list[int], longer: int):
        self.words, self.n = np.array(words, f"U{longer}"), np.array(n, np.int64)
        self.forwards = _matrix(words, longer)
        self.backwards = _matrix([w[::-1] for w in words], longer)
        self.long = self.forwards[:, longer - 1] != 0
        # the place of each word, the most frequent first, then in the order of code points
        order = np.lexsort((self.words, -self.n))
        self.in_order, self.rank = order, np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first columns each row of ``a`` has in common with each row of ``b``."""
    equal = a[:, 0][:, None] == b[:, 0][None, :]
    out = equal.astype(np.uint8 if a.shape[1] < 255 else np.int64)
    for k in range(1, a.shape[1]):
        equal &= a[:, k][:, None] == b[:, k][None, :]
        if not equal.any():
            break
        out += equal
    return out


def near(a: _Words, b: _Words, longer: int, side: str) -> np.ndarray:
    """Which words differ by one edit, of pairs that belong to this side; the longer word has ``longer`` code points."""
    half = longer // 2
    prefix, suffix = _common(a.forwards, b.forwards), _common(a.backwards, b.backwards)
    # a pair with both halves in common is the prefix tile's
    mine = prefix >= half if side == "prefix" else (suffix >= half) & (prefix < half)
    # padding is equal to padding, but a pair of shorter words is another tile's; a word is not its own variant
    return mine & (prefix.astype(np.int64) + suffix >= longer - 1) & (a.long[:, None] | b.long[None, :]) & (prefix < longer)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, form_n, form`` of words that have near ones: their number and the most frequent."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple[int, str], tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))

        def found(matrix: np.ndarray, a: _Words, b: _Words) -> pa.RecordBatch:
            rows = np.flatnonzero(matrix.any(1))
            matrix = matrix[rows]
            best = b.in_order[np.where(matrix, b.rank[None, :], len(b.rank)).min(1)] if len(rows) else rows
            columns = (a.words[rows].tolist(), matrix.sum(1), b.n[best], b.words[best].tolist())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def alone(key: tuple[int, str]) -> pa.RecordBatch:
            held = _Words(*gathered.pop(key), key[0])
            return found(near(held, held, *key), held, held)

        for batch in batches:
            for longer, side, whole, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = longer, side
                if whole:
                    # small tiles of one length and side are compared as one block: words of different tiles lack the half
                    for x in left:
                        gathered[key][0].append(x["word"])
                        gathered[key][1].append(x["n"])
                    if len(gathered[key][0]) >= BLOCK:
                        yield alone(key)
                else:
                    a = _Words([x["word"] for x in left], [x["n"] for x in left], longer)
                    b = _Words([x["word"] for x in right], [x["n"] for x in right], longer) if right else a
                    matrix = near(a, b, longer, side)
                    yield found(matrix, a, b)
                    if right:
                        yield found(matrix.T, b, a)
        for key in list(gathered):
            yield alone(key)

    names = ["word", "n_near", "form_n", "form"]
    compared = tiles(words, block).mapInArrow(compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return compared.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
    )


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of the words with a form, whose counts are ``most`` at most.

    A form is twice as frequent, so a chain has no more than log2 of the counts' range, and each
    round doubles how far a word sees.
    """
    chain = max(1, (most // SELDOMEST).bit_length())
    links = materialise(forms.select("word", F.col("form").alias("root")), "links")
    for _ in range((chain - 1).bit_length()):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "links")
    return links


def group_variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``; words have to be distinct.

    The form of a word is its near word of largest n (ties: smallest in code-point order) if that is
    ``MORE_FREQUENT`` times the word's n. Following forms from the word leads to its root, the word
    itself if it has no form. A tile that holds a large share of all words is compared in blocks that
    Spark deals out one by one. No words, no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    held = words.join(near_words(words, block), "word", "left")
    is_form = F.col("form_n") >= MORE_FREQUENT * F.col("n")
    held = materialise(held.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    ), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(held.where(F.col("form").isNotNull()), most)
    return held.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_prefix_suffix_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return group_variants(count_words(table(spark, sf_dir, "documents")))
