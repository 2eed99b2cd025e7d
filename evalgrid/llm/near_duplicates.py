"""N-gram Jaccard join: MinHash bands propose, whole n-gram sets decide."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import blocks, byte_set, lower_table, mix, run_hashes, runs, small_batches, table
from evalgrid.llm.components import connected_components
from evalgrid.session import materialise

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: hashes of a signature at most
HASHES = 128
#: texts of a candidate group that are compared at once with as many others
BLOCK_TEXTS = 128
#: tasks that the copies of one text are dealt to where one of them is chosen
_SHARES = 16

_WORD = byte_set(range(48, 58), range(97, 123), range(128, 256))
_LOWER = lower_table()
_COLUMNS = 4096


def bands_and_rows(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """The longest bands with which pairs of just ``similarity`` meet in one with at least ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        one = similarity**rows
        bands = 1 if one >= recall else math.ceil(math.log1p(-recall) / math.log1p(-one))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{hashes} hashes do not give recall {recall} at similarity {similarity}")
    return best


def shingles(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``words`` words, their number per row); a shorter text is one, one without words none."""
    data = _LOWER[data]
    begin, end, per_row = runs(_WORD[data], starts)
    hashes = run_hashes(data, begin, end)
    counts = np.where(per_row >= words, per_row - words + 1, (per_row > 0).astype(np.int64))
    first = np.cumsum(per_row) - per_row
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    last = np.repeat(first + per_row, counts)
    out = np.zeros(len(place), np.uint64)
    for k in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(place + k < last, hashes[np.minimum(place + k, max(len(hashes) - 1, 0))], 1) if len(hashes) else out
    return mix(out), counts


def signature(values: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each row that has values."""
    random = np.random.default_rng(11).integers(1, 1 << 62, (2, bands * rows), np.int64).astype(np.uint64)
    multiply, add = random[0] * np.uint64(2) + np.uint64(1), random[1]
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), bands), np.uint64)
    hashed = np.empty_like(values)
    for i in range(bands * rows):
        np.multiply(values, multiply[i], out=hashed)
        hashed += add[i]
        band = out[:, i // rows]
        band *= np.uint64(0x9E3779B97F4A7C15)
        band += np.minimum.reduceat(hashed, starts) >> np.uint64(7)
    return mix(out)


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, starts in blocks(batch.column("text")):
                values, counts = shingles(data, starts, words)
                has = np.flatnonzero(counts)
                ends = np.cumsum(counts)
                keys = [
                    hashlib.blake2b(np.unique(values[ends[i] - counts[i]:ends[i]]).tobytes(), digest_size=16).digest() for i in has
                ]
                found = signature(values, counts, bands, rows) if len(has) else np.zeros((0, bands), np.uint64)
                offsets = pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands)
                rows_ = batch.slice(first, past - first).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([
                    rows_.column("doc_id"), rows_.column("text_key"), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int64).ravel())),
                ], ["doc_id", "text_key", "set_key", "bands"])

    return sign


def _linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets are at least so similar, by exact Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a value that only one set has is in no intersection
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - a] = 1
        common += has @ has.T
    both = sizes[:, None] + sizes - common
    return common >= similarity * both - 1e-6


def _verifier(words: int, similarity: float):
    def verify(key: tuple, group: pa.Table) -> pa.Table:
        one, other = key[1].as_py(), key[2].as_py()
        group = group.combine_chunks()
        ids, weight = group.column("set").to_numpy(), group.column("weight").to_numpy()
        block = group.column("block").to_numpy()
        sets: list[np.ndarray] = []
        for chunk in group.column("text").chunks:
            for _, _, data, starts in blocks(chunk):
                values, counts = shingles(data, starts, words)
                ends = np.cumsum(counts)
                sets += [np.unique(values[e - n:e]) for e, n in zip(ends, counts, strict=True)]
        linked = _linked(sets, similarity)
        np.fill_diagonal(linked, False)
        if one != other:
            linked &= block[:, None] != block
        links = linked @ weight
        # the least member each can reach ties the links of this task together
        root = ids.copy()
        while True:
            least = np.minimum(root, np.where(linked, root, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
            if (least == root).all():
                break
            root = least
        has = links > 0
        return pa.table([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])], ["set", "links", "root"])

    return verify


def _classes(docs: DataFrame, words: int, similarity: float, recall: float) -> DataFrame:
    """text_key, component, class_id, n_links of the texts of linked rows of ``docs`` (doc_id, text, text_key)."""
    small_batches(docs.sparkSession)
    bands, rows = bands_and_rows(similarity, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(
        _signer(words, bands, rows), f"doc_id {kind}, text_key string, set_key binary, bands array<long>"
    )
    texts = signed.groupBy("text_key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("set_key").alias("set_key"), F.min("bands").alias("bands")
    )
    texts = materialise(texts, "texts")
    sets = texts.groupBy("set_key").agg(
        F.min("text_key").alias("text_key"), F.min("least").alias("least"), F.sum("n").alias("weight"), F.min("bands").alias("bands")
    ).withColumn("set", F.monotonically_increasing_id())
    sets = materialise(sets, "sets")

    banded = sets.select("set", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("set").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = banded.join(buckets.select("band", "hash", "least"), ["band", "hash"])
    groups = connected_components(met.select(F.col("set").alias("a"), F.col("least").alias("b")))
    groups = materialise(groups.select(F.col("node").alias("set"), F.col("component").alias("group")), "groups")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    members = groups.join(sizes, "group").withColumn("block", block)
    members = members.join(sets.select("set", "text_key", "weight"), "set")

    distinct = docs.where("text is not null").groupBy("text_key").agg(F.min("text").alias("text"))
    placed = members.join(distinct, "text_key").withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "group", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "set", "weight", "block", "text"
    )
    links = materialise(
        placed.groupBy("group", "one", "other").applyInArrow(_verifier(words, similarity), "set long, links long, root long"), "links"
    )
    classes = connected_components(links.select(F.col("set").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("set").agg(F.sum("links").alias("links"))
    known = sets.join(linked, "set", "left").join(classes.withColumnRenamed("node", "set"), "set", "left")
    known = known.select(
        "set_key", "least", F.coalesce("component", "set").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    ).where("n_links > 0")
    known = materialise(known, "linked")
    named = known.groupBy("component").agg(F.min("least").alias("class_id"))
    by_text = texts.select("text_key", "set_key").join(known.join(named, "component"), "set_key")
    return materialise(by_text.select("text_key", "component", "class_id", "n_links"), "classes")


def join_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every row.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word runs is at least
    ``similarity``; words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, and
    a text of fewer words is one run. ``n_links`` is the number of rows a row is linked to, ``class_id``
    the least doc_id of those it is tied to by links, over however many steps.

    Rows of one set are first made one, so copies are counted, not compared. Sets that agree in a
    MinHash band (bands and rows chosen for ``recall`` at ``similarity``) become one candidate group.
    A group's texts are dealt to blocks, each two blocks are compared by their whole sets in one task,
    which returns counts and a tree of links for each, not pairs. What is shuffled with its text is
    only what has a candidate, after copies are dropped where they are read.

    NULL texts and texts without words are linked to none and their own class. Rows of one NULL or
    repeated doc_id are rows of their own; a class of NULL ids only has id NULL. Other columns are ignored.
    No documents, no rows.
    """
    docs = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    classes = _classes(docs, words, similarity, recall).withColumn("in_class", F.lit(True))
    found = docs.select("doc_id", "text_key").join(classes, "text_key", "left")
    return found.select(
        "doc_id", F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row, with all columns, of each class of ``join_similar``: that of the least doc_id, a NULL id being
    the greatest, then of the least digest of its text. Of rows equal in both, any one."""
    key = _free_name("text_key", docs.columns)
    keyed = docs.withColumn(key, F.md5("text"))
    classes = _classes(keyed.select("doc_id", "text", F.col(key).alias("text_key")), words, similarity, recall)
    members = keyed.select("doc_id", F.col(key).alias("text_key")).join(classes.select("text_key", "component"), "text_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"))).alias("first")
    decided = classes.select("text_key", "component").join(
        members.groupBy("component").agg(first).select("component", "first.doc_id", F.col("first.text_key").alias("first_key")), "component"
    )
    # a text with very many copies is dealt to several tasks by the copies' ids
    shares = F.sequence(F.lit(0), F.lit(_SHARES - 1))
    decided = decided.select("text_key", "first_key", F.col("doc_id").alias("first_id"), F.explode(shares).alias("share"))
    decided = materialise(decided.withColumn("in_class", F.lit(True)), "decided")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)).cast("int")
    row = F.struct(*(keyed["`" + c.replace("`", "``") + "`"] for c in docs.columns))
    rows = keyed.select(row.alias("row"), F.col(key).alias("text_key"), F.col("doc_id").alias("own_id"), share.alias("share"))
    # one shuffle of the texts at any size, rather than none where the table happens to be small
    met = rows.join(decided.hint("merge"), ["text_key", "share"], "left")
    nth = F.row_number().over(Window.partitionBy("text_key", "share", "own_id").orderBy(F.lit(1)))
    chosen = (F.col("text_key") == F.col("first_key")) & F.col("own_id").eqNullSafe(F.col("first_id"))
    kept = met.withColumn("nth", nth).where(F.col("in_class").isNull() | (chosen & (F.col("nth") == 1)))
    return kept.select("row.*")


def _free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
