"""Helpers the language-model data operators share: tables, folds, Arrow text blocks."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one vectorised step works on; a longer text is a block of its own
BLOCK = 1 << 20

#: rows that come to a Python worker at once
BATCH_ROWS = 1000

# An odd multiplier for word hashes (its inverse modulo 2**64 follows) and a mixer.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have texts come to Python workers in batches of a few MB, as workers keep the memory of their largest.

    Lowers the session's number of rows in an Arrow batch, and never raises it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds).cast("int")


def draw_rows(rows: DataFrame, group: str, wanted: int) -> DataFrame:
    """About ``wanted`` rows of each value of ``group`` (few values), by a hash of doc_id and text, with that hash as ``draw``.

    Rows equal in doc_id, text and group are one, so no id, not even a NULL one, and no copies bring more rows than that.
    """
    rows = rows.select("doc_id", group, "text", F.xxhash64("doc_id", "text").alias("draw"))
    counts = {r[group]: r.n for r in rows.groupBy(group).agg(F.count_distinct("draw").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for value, n in sorted(counts.items()) for x in (value, min(1.0, wanted / n))])
    # the digest is hashed again, as folds and other samples hash ids too
    place = F.pmod(F.xxhash64(F.lit(group), "draw"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(place < share[F.col(group)])
    return drawn.groupBy(group, "draw").agg(F.first("text").alias("text"))


def strings(column: pa.Array) -> list[str]:
    """The column as text; NULL is empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row's begin; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def blocks(
    column: pa.Array, size: int = BLOCK, most_rows: int = 4096
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, row starts) of runs of whole rows of about ``size`` bytes."""
    data, starts = utf8(column)
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, min(row + most_rows, int(np.searchsorted(starts, starts[row] + size, "right")) - 1))
        yield row, end, data[starts[row]:starts[end]], starts[row:end + 1] - starts[row]
        row = end


def byte_set(*members: int | range) -> np.ndarray:
    """A table of 256 flags."""
    flags = np.zeros(256, bool)
    for x in members:
        flags[x if isinstance(x, int) else list(x)] = True
    return flags


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that stay within a row: first position, past the last, runs per row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, starts))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        p = np.full(max(n, BLOCK + 65536), base, np.uint64)
        p[0] = 1
        known = np.cumprod(p, dtype=np.uint64)
        if n <= BLOCK + 65536:
            _powers[str(base)] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27)) * np.uint64(_BASE)


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; equal bytes have equal hashes wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[:len(data)], out=total[1:])
    # divided by the power of its place, the weighted sum no longer depends on the place
    return mix((total[end] - total[begin]) * _power(_INVERSE, len(data) + 1)[begin])


def seen_once(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row and value."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def keep_rows(rows: DataFrame, wanted: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, that a function of a batch says are wanted. Nothing is shuffled."""
    small_batches(rows.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch), pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)
