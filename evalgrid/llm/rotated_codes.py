"""Nearest neighbours by inner product from randomly rotated one-bit codes."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.llm.common import table
from evalgrid.session import materialise

NEAREST = 20
QUERY_STEP = 20
#: standard deviations of the estimate's error that its bounds allow for
ERROR = 2.5
#: bits of a code at least; a shorter vector is turned into that many dimensions, which narrows the bounds
BITS = 512
#: rows and queries that one task holds at most, and the rows a block has at least where there are many tasks
ROWS, QUERIES, LEAST_ROWS = 65_536, 32_768, 512
_SLICE, _TILE = 128, 4_096
_GUESSES = 3
#: the signs that each value of a byte stands for
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


@lru_cache(4)
def _rotation(dim: int) -> np.ndarray:
    """A matrix (dim, bits) that keeps lengths, drawn at random; bits is a multiple of 8."""
    bits = max(BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng([17, dim]).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def _usable(vector: Column) -> Column:
    """Whole, finite and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors) for each dimension of a column of whole vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, values[starts[at][:, None] + np.arange(dim)]


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension that occurs."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {dim: (m.sum(0, np.float64), len(m)) for dim, _, m in _matrices(batch.column(0))}
            dims = [d for d, (t, _) in sums.items() for _ in t]
            yield pa.RecordBatch.from_arrays([
                pa.array(dims, pa.int32()), pa.array([i for d in sums for i in range(d)], pa.int32()),
                pa.array([x for t, _ in sums.values() for x in t], pa.float64()),
                pa.array([sums[d][1] for d in dims], pa.int64()),
            ], ["dim", "at", "total", "n"])

    summed = vectors.select("vector").mapInArrow(add_up, "dim int, at int, total double, n long")
    rows = summed.groupBy("dim", "at").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.dim, np.zeros(r.dim))[r.at] = r.mean
    return out


def encode(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """id, vector, dim and its code: a bit for the sign of each rotated coordinate of the offset from the
    centre, the offset's length, and how far the code's direction agrees with it (the correction)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # one vector for each dimension

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _TILE):
                batch = whole.slice(at, _TILE)
                for dim, rows, m in _matrices(batch.column("vector")):
                    offset = (m - shared.value[dim]) @ _rotation(dim)
                    length = np.linalg.norm(offset, axis=1)
                    agree = np.ones(len(rows))
                    np.divide(np.abs(offset).sum(1), length * np.sqrt(offset.shape[1]), out=agree, where=length > 0)
                    bits = [b.tobytes() for b in np.packbits(offset > 0, axis=1)]
                    yield pa.RecordBatch.from_arrays([
                        *batch.take(pa.array(rows)).select(["id", "vector"]).columns, pa.array(np.full(len(rows), dim, np.int32)),
                        pa.array(bits, pa.binary()), pa.array(length), pa.array(agree),
                    ], ["id", "vector", "dim", "bits", "length", "agree"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(
        code, f"id long, vector {kind}, dim int, bits binary, length double, agree double"
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(-1, dim)


def _products(offset: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Products of each query's rotated offset with each code's signs: a table lookup for each byte of a code."""
    parts = offset.astype(np.float32).reshape(len(offset), -1, 8)
    tables = np.ascontiguousarray(np.einsum("vb,qcb->cvq", _SIGNS, parts))
    out = np.empty((len(offset), len(packed)), np.float32)
    for at in range(0, len(packed), _TILE):
        tile = packed[at:at + _TILE]
        total = np.zeros((len(tile), len(offset)), np.float32)
        for table_, values in zip(tables, tile.T, strict=True):
            total += table_[values]
        out[:, at:at + _TILE] = total.T
    return out


def search_block(queries: pa.Table, rows: pa.Table, centre: np.ndarray, nearest: int) -> tuple[pa.Table, int]:
    """The ``nearest`` rows of a block for each query, ordered by exact inner product and id, and how many products that took.

    A row's exact product is computed if the upper bound of its estimate reaches the ``nearest``-th
    largest exact product among the rows of the best estimates.
    """
    dim = len(centre)
    q, q_ids = _matrix(queries.column("vector"), dim), queries.column("id").to_numpy()
    o, ids = _matrix(rows.column("vector"), dim), rows.column("id").to_numpy()
    rotation = _rotation(dim)
    bits = rotation.shape[1]
    packed = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
    length, agree = rows.column("length").to_numpy(), rows.column("agree").to_numpy()
    scale = (length / (np.sqrt(bits) * agree)).astype(np.float32)
    spread = (length * np.sqrt(np.maximum(1 - agree**2, 0) / (bits - 1)) / agree * ERROR).astype(np.float32)
    level = o @ centre
    out_q, out_o, out_s, reranked = [], [], [], 0
    for at in range(0, len(q_ids), _SLICE):
        own = q[at:at + _SLICE]
        offset = (own - centre) @ rotation
        # with the centre's exact products, an estimate of the whole product
        known = level + ((own - centre) @ centre)[:, None]
        guess = _products(offset, packed) * scale + known.astype(np.float32)
        error = np.linalg.norm(offset, axis=1)[:, None].astype(np.float32) * spread + 1e-5
        same = q_ids[at:at + _SLICE, None] == ids
        guess[same] = -np.inf
        # the best guesses' exact scores tell what a row has to reach
        some = min(_GUESSES * nearest, len(ids))
        best = np.argpartition(guess, len(ids) - some, axis=1)[:, len(ids) - some:]
        exact = np.einsum("qd,qkd->qk", own, o[best])
        exact[np.take_along_axis(same, best, 1)] = -np.inf
        k = min(nearest, some)
        least = np.partition(exact, some - k, axis=1)[:, some - k]
        wanted = guess + error >= least[:, None]
        np.put_along_axis(wanted, best, np.take_along_axis(wanted, best, 1) | (exact >= least[:, None]), 1)
        which, row = np.nonzero(wanted & ~same)
        reranked += len(row)
        score = np.empty(len(row))
        for a in range(0, len(row), 200_000):
            score[a:a + 200_000] = (own[which[a:a + 200_000]] * o[row[a:a + 200_000]]).sum(1)
        order = np.lexsort((ids[row], -score, which))
        which, row, score = which[order], row[order], score[order]
        first = np.searchsorted(which, which)
        best = np.arange(len(which)) - first < nearest
        out_q.append(q_ids[at + which[best]])
        out_o.append(ids[row[best]])
        out_s.append(score[best])
    return pa.table([
        pa.array(np.concatenate(out_q), pa.int64()), pa.array(np.concatenate(out_o), pa.int64()), pa.array(np.concatenate(out_s))
    ], ["query_id", "vec_id", "score"]), reranked


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, rows: int = ROWS, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows of each query, without its own id.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. The score is the
    inner product of the original vectors in double precision, ties go to the smaller id. Every row
    is coded and compared with every query: rows and queries are dealt to blocks of at most about
    ``rows`` and ``queries``, each pair of blocks is one task, and the blocks' best are merged.
    A row that is nearest can be missed only where an estimate errs by more than its bound.

    A row goes to a block with its code and its vector, of floats where the table holds floats: nearly
    each row of a block is reranked for some of so many queries, so fetching vectors for the pairs that
    the bounds leave would shuffle more.

    NULL ids and vectors that are NULL, empty, zero or hold NULL or a non-finite number take no part.
    Vectors of another length than the query's are not compared with it. Rows that repeat an id are
    candidates each; a query's id asks once, with the greatest of its vectors, and finds no row of
    that id. Other columns are ignored. No rows, no rows.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"))
    usable = usable.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    centres = _centres(usable)
    coded = materialise(encode(usable, centres), "codes")
    asked = coded.withColumnRenamed("id", "vec_id").where(is_query).withColumnRenamed("vec_id", "id")
    asked = materialise(asked.groupBy("id").agg(F.max("vector").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    n_rows, n_queries = coded.count(), asked.count()
    columns = max(1, -(-n_queries // queries))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = max(1, -(-n_rows // rows), min(-(-tasks // columns), n_rows // LEAST_ROWS))
    # dealt by their place in the tables, as very many rows may share an id
    place = F.xxhash64(F.lit("block"), F.monotonically_increasing_id())
    left = asked.withColumn("column", F.pmod(place, F.lit(columns)).cast("int"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    right = coded.withColumn("line", F.pmod(place, F.lit(lines)).cast("int"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    shared = spark.sparkContext.broadcast(centres)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return search_block(left, right, shared.value[key[0].as_py()], nearest)[0]

    key = ("dim", "line", "column")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
