import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evalgrid.llm import rotated_codes

SF = "/root/testdata/sf0.01"


def brute_force(rows, queries, nearest):
    out = {}
    for q, v in rows:
        if q in queries:
            scored = [(-float(np.dot(np.array(v, np.float64), np.array(o, np.float64))), i) for i, o in rows if i != q and len(o) == len(v)]
            out[q] = sorted(scored)[:nearest]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_scores_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = _found(rotated_codes.op7_rotated_codes(spark, SF))
    expected = brute_force(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(found) == set(expected)
    vectors = dict(rows)
    hits = 0
    for q, best in found.items():
        assert [r for r, _, _ in best] == list(range(1, 21)) and len({i for _, i, _ in best}) == 20
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(best, best[1:]))
        for _, i, s in best:
            assert abs(s - np.dot(np.array(vectors[q], np.float64), np.array(vectors[i], np.float64))) < 1e-12
        hits += len({i for _, i, _ in best} & {i for _, i in expected[q]})
    assert hits >= 0.99 * 20 * len(found)


def test_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(24).round(3).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(60)]  # many of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = _found(rotated_codes.nearest_neighbours(df, F.col("vec_id") % 100 == 0, rows=400, queries=5))
    expected = brute_force(rows, {i for i, _ in rows if i % 100 == 0}, 20)
    assert set(found) == set(expected)
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i in expected[q]}) for q in found)
    assert hits >= 0.98 * 20 * len(found)


def test_an_id_that_holds_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).round(3).tolist()) for i in range(400)]
    rows += [(100, rng.standard_normal(16).round(3).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = _found(rotated_codes.nearest_neighbours(df, F.col("vec_id") % 50 == 0, rows=100, queries=3))
    asked = {q: max(v for i, v in rows if i == q) for q in range(0, 400, 50)}
    assert set(found) == set(asked)
    hits = 0
    for q, own in asked.items():
        scores = sorted((float(np.dot(own, v)) for i, v in rows if i != q), reverse=True)[:20]
        hits += np.isclose([s for _, _, s in found[q]], scores).sum()
        assert all(i != q for _, i, _ in found[q])
    assert any(i == 100 for q in found for _, i, _ in found[q]) and hits >= 0.98 * 20 * len(found)


def test_estimates_come_from_packed_bits():
    rng = np.random.default_rng(8)
    offset, signs = rng.standard_normal((5, 512)), rng.standard_normal((9000, 512)) > 0
    estimate = rotated_codes._products(offset, np.packbits(signs, axis=1))
    assert np.allclose(estimate, offset @ (signs * 2.0 - 1).T, atol=1e-3)


def test_bounds_leave_few_rows(spark):
    """Far from the origin too, where the products with the centre are most of a score."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64))
    for shift in (0.0, 3.0, -3.0):
        vectors = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 64)) + shift).tolist()
        df = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<double>")
        centre = np.mean(vectors, axis=0)
        rows = pa.Table.from_batches(rotated_codes.encode(df, {64: centre}).toArrow().to_batches())
        queries = rows.take(pa.array(range(0, 4000, 40)))
        found, reranked = rotated_codes.search_block(queries, rows, centre, 20)
        assert reranked < 0.1 * 4000 * 100
        exact = np.array(vectors)[::40] @ np.array(vectors).T
        exact[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
        best = {(40 * i, int(j)) for i, row in enumerate(exact) for j in np.argsort(-row)[:20]}
        got = set(zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True))
        assert len(got & best) >= 0.99 * len(best)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, []), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (10, [-1.0, 0.0]), (10, [-3.0, 0.0]), (20, [0.0, 0.0]), (40, [1.0, 1.0, 1.0]), (1, [2.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = _found(rotated_codes.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert [(i, s) for _, i, s in found[0]] == [(1, 2.0), (1, 2.0), (2, 2.0), (10, -1.0), (10, -3.0)]
    assert [(i, s) for _, i, s in found[40]] == [(9, 6.0)] and set(found) == {0, 40}
    assert rotated_codes.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
