import math

import numpy as np

from retentia.llm.top_k import best_of_tile, tile_scores, top_k, vector_table

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, shard int, block int, query_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], SCHEMA)


def brute(rows, k, scale=64):
    """As the query's SQL: every row is a candidate, a query id has one list."""
    vectors = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in {i for i, _ in vectors if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, w in vectors if j == q for i, v in vectors if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(out)


def found(spark, rows, k=5, **blocks):
    vectors = vector_table(table(spark, rows))
    best = top_k(vectors, vectors.where("vec_id % 20 = 0"), k, **blocks)
    return sorted(tuple(r) for r in best.collect())


def test_many_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(240)]
    rows += [(300 + i, rows[40][1]) for i in range(30)]  # ties: copies of a query
    assert found(spark, rows, block_queries=3, shard_vectors=8) == brute(rows, 5)


def test_nulls_gaps_repeats_and_short_tables(spark):
    rows = [
        (0, [1.0, 2.0]),
        (0, [0.5, 9.0]),
        (20, [1.0]),  # missing components count as 0
        (40, []),
        (1, None),
        (2, [1.0, None]),
        (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]),
        (None, [1.0, 1.0]),
        (5, [-1.0, -1.0]),
        (6, [-1.0, -1.0]),
    ]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 30, rng.normal(size=4).astype("float32").tolist()) for i in range(200)]
    assert found(spark, rows, block_queries=3, shard_vectors=8) == brute(rows, 5)
    assert len(found(spark, [(20, [1.0]), (1, [2.0]), (1, [3.0])])) == 2


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []


def test_large_components_stay_exact():
    q = np.array([[2**31 - 1, 2**31 - 1]], dtype=np.int64)
    v = np.array([[2**31 - 1, 1], [2**31 - 1, 2]], dtype=np.int64)
    assert tile_scores(q, v).tolist() == [[(2**31 - 1) ** 2 + 2**31 - 1, (2**31 - 1) ** 2 + 2 * (2**31 - 1)]]
    ids, vec, score = best_of_tile(np.array([9]), q, np.array([4, 2]), v, 1)
    assert vec[0] == 2 and score[0] == (2**31 - 1) ** 2 + 2 * (2**31 - 1)
