"""Token counts of whole texts from a table of frequent pre-tokens and worker caches."""

from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import small_batches, strings, table
from evalgrid.session import materialise

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: frequent pre-tokens in the broadcast table; it holds at most so many of up to 64 bytes
TABLE_ROWS = 32_768
#: pre-tokens of a summary for each row of the table
_SPARE = 2
#: summaries that are merged at once
_FAN = 16
#: pre-tokens that a worker's cache holds before it starts anew
_CACHE_ROWS = 300_000
_LONGEST = 64
#: pre-tokens that a task counts beyond its summary before it is cut
_LEAST_ROOM = 100_000


def _pretokens(text: bytes) -> list[bytes]:
    """The text between ASCII white space, its wholly ASCII pieces lower-cased.

    This tokenizer works within white space, composes letters and then lower-cases them, so the
    counts of these pieces add up to the count of the text. Others keep their capitals, as some
    letters compose in lower case only.
    """
    if text.isascii():
        return text.lower().split()
    return [x.lower() if x.isascii() else x for x in text.split()]


def _cut(counts: dict[bytes, int], most: int) -> dict[bytes, int]:
    """The ``most`` greatest counts, each less by the greatest count that goes: a Misra-Gries summary of the counts.

    However summaries are cut and added up, a count falls short by less than the total over ``most``,
    so that whatever is more frequent than that stays.
    """
    if len(counts) <= most:
        return counts
    level = sorted(counts.values())[-most - 1]
    return {w: n - level for w, n in counts.items() if n > level}


def frequent_pretokens(docs: DataFrame, rows: int = TABLE_ROWS) -> list[bytes]:
    """The most frequent pre-tokens, of up to 64 bytes, of all texts.

    Each task counts its pre-tokens in a summary of bounded size; summaries, not pre-tokens, are sent
    on and merged ``_FAN`` at a time until one is left, so neither a task nor the driver ever holds more
    than that many. Counts are those of a Misra-Gries summary, too small by less than all pre-tokens
    over ``_SPARE`` times ``rows``; this decides what is in the table, never a document's count.
    """
    most = _SPARE * rows
    schema = "slot int, piece binary, n long"

    def as_rows(slot: int, counts: dict[bytes, int]) -> list[pa.Array]:
        slots = pa.array([slot] * len(counts), pa.int32())
        return [slots, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(_pretokens((text.as_py() or "").encode()))
                if len(counts) > 4 * most + _LEAST_ROOM:
                    counts = Counter(_cut({w: n for w, n in counts.items() if len(w) <= _LONGEST}, most))
        best = _cut({w: n for w, n in counts.items() if len(w) <= _LONGEST}, most)
        yield pa.RecordBatch.from_arrays(as_rows(TaskContext.get().partitionId(), best), ["slot", "piece", "n"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for batch in group.to_batches():
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                counts[piece] += n
        return pa.table(as_rows(key[0].as_py(), _cut(counts, most)), ["slot", "piece", "n"])

    found = materialise(docs.select("text").mapInArrow(summarise, schema), "summaries")
    slots = (found.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        slots = -(-slots // _FAN)
        found = found.withColumn("slot", F.pmod("slot", F.lit(slots)).cast("int")).groupBy("slot").applyInArrow(merge, schema)
    best = found.orderBy(F.desc("n"), "piece").limit(rows).select("piece").toArrow()
    return best.column("piece").to_pylist()


class _Lengths(dict):
    """Pre-token to its number of tokens; grows by what it is asked, back to ``first`` when full.

    A worker keeps the tokenizer from task to task.
    """

    def __init__(self, path: str):
        self.tokenizer, self.first = _tokenizer(path), {}

    def begin_with(self, first: dict[bytes, int]) -> None:
        self.first = first
        self.clear()
        self.update(first)

    def learn(self, pieces: set[bytes]) -> None:
        missing = list(pieces - self.keys())
        if len(self) + len(missing) > len(self.first) + _CACHE_ROWS:
            self.clear()
            self.update(self.first)
            missing = list(pieces - self.keys())
        found = self.tokenizer.encode_batch_fast([x.decode() for x in missing], add_special_tokens=False)
        self.update(zip(missing, map(len, found), strict=True))


@cache
def _lengths_of(path: str) -> _Lengths:
    return _Lengths(path)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    First the ``table_rows`` most frequent pre-tokens are found (``frequent_pretokens``), encoded once
    and broadcast as a table of lengths (under 3 MB). Then each task adds up the lengths of its
    pre-tokens, encoding what the table lacks once per worker. No exchange is keyed by pre-tokens,
    and the table decides speed only, never a count. A text that holds an added token's
    string is encoded whole, as the tokenizer treats that string before it splits.

    NULL and empty texts have 0 tokens. Repeated rows and NULL ids are counted like any other row.
    Columns other than doc_id and text are ignored. No documents, no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = _tokenizer(path)
    frequent = frequent_pretokens(docs, table_rows)
    encoded = tokenizer.encode_batch_fast([x.decode() for x in frequent], add_special_tokens=False)
    lengths = spark.sparkContext.broadcast((frequent, bytes(min(len(x), 255) for x in encoded)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _lengths_of(path)
        tokenizer = known.tokenizer
        added = [x.content.lower().encode() for x in tokenizer.get_added_tokens_decoder().values()]
        pieces, sizes = lengths.value
        known.begin_with({p: n for p, n in zip(pieces, sizes, strict=True) if n < 255})
        for batch in batches:
            texts = strings(batch.column("text"))
            n_tokens, waiting, held = [0] * len(texts), [], 0
            for i, text in enumerate(texts):
                coded = text.encode()
                lowered = coded.lower()
                if any(x in lowered for x in added):
                    n_tokens[i] = len(tokenizer.encode(text, add_special_tokens=False))
                else:
                    waiting.append((i, _pretokens(coded)))
                    held += len(waiting[-1][1])
                if waiting and (held > 100_000 or i == len(texts) - 1):
                    known.learn(set().union(*(p for _, p in waiting)))
                    for k, found in waiting:
                        n_tokens[k] = sum(map(known.__getitem__, found))
                    waiting, held = [], 0
            for k, found in waiting:
                known.learn(set(found))
                n_tokens[k] = sum(map(known.__getitem__, found))
            n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        # the worker lives on and may have other work next
        known.begin_with({})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
