import numpy as np
import pytest

from retentia.llm import multi_index
from retentia.llm.multi_index import Codebooks, _Shards, build_index, fitted_centroids, vector_rows
from retentia.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, row int, cell string, vec int, copy int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def brute(rows, k=5, asked=lambda i: i % 50 == 0):
    """{(query row number): [(vec_id, score)]} over all pairs."""
    rows, out = usable(rows), []
    width = max((len(v) for _, v in rows), default=0)
    matrix = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    norm = np.sqrt((matrix**2).sum(axis=1))
    for (i, _), q, length in zip(rows, matrix, norm):
        if asked(i):
            scored = [(-float((q * v).sum() / (length * m)), j) for (j, _), v, m in zip(rows, matrix, norm) if j != i]
            out.append((i, [(j, -s) for s, j in sorted(scored)[:k]]))
    return out


def found(spark, rows, k=5, recall=1.0):
    vectors = vector_rows(table(spark, rows))
    return build_index(vectors, k, recall).search(vectors.where("vec_id % 50 = 0"), k).collect()


def assert_exact(spark, rows, k=5):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found(spark, rows, k))
    want = sorted((q, n, j, s) for q, near in brute(rows, k) for n, (j, s) in enumerate(near, start=1))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_whole_walk_is_exact_in_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ENTRIES", 20)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(multi_index, "SCORED_QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # copies of a query: ties to the smaller id
    rows += [(2000 + i, (np.array(rows[50][1]) * (i + 2)).tolist()) for i in range(30)]  # the same direction
    rows += [(3000 + i, (np.array(rows[100][1]) + rng.normal(size=6) * 1e-3).tolist()) for i in range(120)]  # a full cell
    assert_exact(spark, rows)


def test_nulls_zeros_gaps_repeats_and_short_tables(spark):
    rows = [
        (0, [1.0, 2.0, 3.0]),
        (0, [0.5, 9.0]),  # an id twice; missing components count as 0
        (50, [1.0]),
        (100, []),
        (150, None),
        (200, [0.0, -0.0]),
        (1, [1.0, None]),
        (2, [float("nan"), 1.0]),
        (3, [float("inf"), 1.0]),
        (None, [1.0, 1.0]),
        (5, [-1.0, -1.0]),
        (5, [-1.0, -1.0]),
        (6, [1e200, 1e200]),  # squares overflow
        (7, [1e-200, 1e-200]),
    ]
    got = sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in found(spark, rows, k=20))
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    plain = {0: [[1, 2, 3], [0.5, 9, 0]], 50: [[1, 0, 0]], 5: [[-1, -1, 0]] * 2, 6: [[1, 1, 0]], 7: [[1, 1, 0]]}
    want = [(q, j, round(float(cos(a, b)), 9)) for q in (0, 50) for a in plain[q] for j in plain if j != q for b in plain[j]]
    assert got == sorted(want)
    assert len(found(spark, rows, k=2)) == 3 * 2


def test_empty_lone_and_one_component(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert_exact(spark, [(i, [float(i - 3)]) for i in range(0, 200, 25)])


def test_many_rows_of_one_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 500)]
    assert_exact(spark, rows)


def test_measured_budget_reaches_the_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=8)).tolist()) for i in range(3000)]
    vectors = vector_rows(table(spark, rows))
    index = build_index(vectors, 5, 0.95)
    assert index.budget < 1500 and index.counts.sum() == 3000
    got = {(r.query_id, r.vec_id) for r in index.search(vectors.where("vec_id % 50 = 0")).collect()}
    want = {(q, j) for q, near in brute(rows) for j, _ in near}
    assert len(got & want) / len(want) >= 0.9


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(4)
    books = Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    vector = rng.normal(size=6)
    cells = books.walk(vector, np.ones(35, dtype=int), 35)
    unit = vector / np.linalg.norm(vector)
    d = [((unit[:3] - books.first[c // 5]) ** 2).sum() + ((unit[3:] - books.second[c % 5]) ** 2).sum() for c in cells]
    assert sorted(cells) == list(range(35)) and np.all(np.diff(d) > -1e-12)
    assert len(books.walk(vector, np.full(35, 4), 9)) == 3


def test_shards_hold_every_entry(monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ENTRIES", 10)
    counts = np.array([0, 3, 4, 25, 0, 9, 9, 1, 40, 40, 2])
    size = _Shards(counts)
    cells = np.repeat(np.arange(len(counts)), counts)
    shard = size.of(cells, np.arange(len(cells)) << 20)
    for cell in range(len(counts)):
        asked = dict(size.asked(np.array([cell])))
        assert set(shard[cells == cell]) <= set(asked)
        for s, bits in asked.items():
            seen = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) + size.first_cell[s]
            assert seen.tolist() == [cell]
    assert np.bincount(shard).max() < 25


def test_centroids_of_few_points():
    assert len(fitted_centroids(np.ones((9, 2)), 4)) == 1
    assert fitted_centroids(np.zeros((3, 0)), 4).shape == (1, 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_finds_the_neighbours(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op13_multi_index"](spark, path).collect()
    want = brute(rows)
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((q, n + 1) for q, near in want for n in range(len(near)))
    true = {(q, j): s for q, near in want for j, s in near}
    hits = [r for r in got if (r.query_id, r.vec_id) in true]
    assert len(hits) / len(true) >= 0.9
    assert np.allclose([r.score for r in hits], [true[r.query_id, r.vec_id] for r in hits], rtol=0, atol=1e-12)
