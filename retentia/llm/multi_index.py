"""Nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length one, where the nearest by cosine are the nearest
by distance, and cut into two halves. Each half has its own centroids, so that
K + K centroids make K * K cells; every vector is listed in the cell of its two
nearest centroids. A query sorts both sets of centroids by distance to its own
halves and walks the pairs in the order of the summed distance with a heap,
until the cells behind it hold enough entries. Only those are compared with
it, by their exact cosine.

How many entries are enough is measured: for a bounded sample of the vectors
the true neighbours are found by a full scan, and the budget is what it takes
to reach the asked share of them.

Entries lie in shards of neighbouring cells (a large cell is dealt over
several), queries in blocks. A query goes once to each shard that holds one of
its cells, with a bit for each cell of that shard; a tile (shard, block) is a
matrix product.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mixed
from .store import written
from .top_k import whole_vector

#: Components of the sample that the centroids are fitted on (32 MB as doubles).
SAMPLE_COMPONENTS = 1 << 22
#: Vectors whose true neighbours are looked up to measure the budget.
MEASURED_QUERIES = 512
#: Entries of an average cell, and the most centroids of a half.
CELL_ENTRIES, MOST_CENTROIDS = 8, 256
KMEANS_ROUNDS = 12
SHARD_ENTRIES = 16_384
BLOCK_QUERIES = 4_096
#: Queries of a tile whose scores are in memory at a time.
SCORED_QUERIES = 256
#: More than rounding can change a cosine.
SLACK = 1e-9


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; components are scaled first, so that no square overflows."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    safe = np.where(largest > 0, largest, 1.0)
    return largest * np.sqrt(((vectors / safe[:, None]) ** 2).sum(axis=1))


def units(vectors: np.ndarray) -> np.ndarray:
    norm = lengths(vectors)
    return vectors / np.where(norm > 0, norm, 1.0)[:, None]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of each vector with the query; equal vectors get equal bits."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        own, squares = (query * query).sum(), (vectors * vectors).sum(axis=1)
        score = (vectors * query).sum(axis=1) / (np.sqrt(own) * np.sqrt(squares))
    # squares that overflow or lose digits: scaled vectors instead
    odd = (np.minimum(squares, own) < 1e-250) | (np.maximum(squares, own) > 1e250)
    if odd.any():
        score[odd] = (units(vectors[odd]) * units(query[None])).sum(axis=1)
    return score


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)
    return np.maximum(d, 0.0)


def fitted_centroids(points: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means from distinct points drawn with a seed; a centroid that loses
    all its points stays where it is."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        nearest = _distances(points, centroids).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        found, starts = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(points[order], starts, axis=0)
        moved = centroids.copy()
        moved[found] = sums / np.diff(np.append(starts, len(points)))[:, None]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


@dataclass
class Codebooks:
    """Centroids of the first and of the second half."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit, cut = units(vectors), self.first.shape[1]
        return unit[:, :cut], unit[:, cut:]

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.halves(vectors)
        near = [_distances(x, c).argmin(axis=1) for x, c in ((a, self.first), (b, self.second))]
        return near[0] * len(self.second) + near[1]

    def walk(self, vector: np.ndarray, counts: np.ndarray, entries: int) -> list[int]:
        """The cells behind the query, in the order of the summed distance of
        their centroids, until they hold so many entries."""
        a, b = self.halves(vector[None])
        d1, d2 = _distances(a, self.first)[0], _distances(b, self.second)[0]
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        d1, d2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), (o1 * len(o2)).tolist(), o2.tolist()
        n1, n2, held, cells = len(d1), len(d2), 0, []
        heap = [(d1[0] + d2[0], 0, 0)]
        while heap and held < entries:
            _, i, j = heap[0]
            cell = o1[i] + o2[j]
            cells.append(cell)
            held += counts[cell]
            if j + 1 < n2:
                heapq.heapreplace(heap, (d1[i] + d2[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < n1:  # the first pair of a row opens the next row
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        return cells


def best_of_shard(query_ids, queries, vec_ids, vectors, visible, k: int):
    """(query number, vec_id, score) of each query's k best among the vectors
    it may see (``visible``: a function from query numbers to a matrix of
    bools), ids unlike its own; ties go to the smaller id."""
    unit, out = units(vectors), []
    for at in range(0, len(queries), SCORED_QUERIES):
        some = slice(at, at + SCORED_QUERIES)
        open_ = visible(some) & (query_ids[some][:, None] != vec_ids[None, :])
        scores = np.where(open_, units(queries[some]) @ unit.T, -np.inf)
        last = max(0, len(vec_ids) - k)
        least = np.partition(scores, last, axis=1)[:, last] if len(vec_ids) else np.empty(0)
        for row, floor in enumerate(least):
            near = np.flatnonzero(open_[row] & (scores[row] >= floor - SLACK))
            exact = cosines(queries[at + row], vectors[near])
            order = np.lexsort((vec_ids[near], -exact))[:k]
            out.append((np.full(len(order), at + row), vec_ids[near[order]], exact[order]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(part) for part in zip(*out))


@dataclass
class MultiIndex:
    """``entries``: row, vec_id, vec, cell, stored. ``counts``: entries of each
    cell. ``budget``: entries that a query visits at least."""

    entries: DataFrame
    codebooks: Codebooks | None
    counts: np.ndarray
    width: int
    budget: int

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The k nearest found of every row of ``queries`` (vec_id, vec, of
        the index's width): query_id, rank (from 1), vec_id, score (cosine).
        Rows with the query's own id are no candidates; ties go to the
        smaller id; with fewer than k candidates all are found."""
        spark = self.entries.sparkSession
        schema = "query_row bigint, query_id bigint, vec_id bigint, score double"
        if self.codebooks is None:
            return _ranked(spark.createDataFrame([], schema), k)
        queries = _filled(queries.select(F.monotonically_increasing_id().alias("query_row"), "vec_id", "vec"), self.width)
        queries = written(queries, "queries")
        # rows that share the query's id take places in its cells
        owned = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
        size = _Shards(self.counts)
        blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
        books, counts, budget = self.codebooks, self.counts, max(self.budget, k + owned)

        walked = pa.schema(
            [("query_row", pa.int64()), ("query_id", pa.int64()), ("query", pa.list_(pa.float64())), ("shard", pa.int64()), ("cells", pa.binary())]
        )

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, out = _rows(batch.column(2)), [[] for _ in walked]
                for row, query_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), vectors):
                    for shard, bits in size.asked(np.array(books.walk(vector, counts, budget))):
                        for values, value in zip(out, (row, query_id, vector.tolist(), shard, bits)):
                            values.append(value)
                    if len(out[0]) >= 1024:
                        yield pa.RecordBatch.from_pydict(dict(zip(walked.names, out)), schema=walked)
                        out = [[] for _ in walked]
                yield pa.RecordBatch.from_pydict(dict(zip(walked.names, out)), schema=walked)

        left = queries.mapInArrow(walk, "query_row bigint, query_id bigint, query array<double>, shard bigint, cells binary")
        left = left.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = size.of(batch["cell"].to_numpy(), batch["row"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vec"], batch["cell"], pa.array(shard)], names=["vec_id", "vec", "cell", "shard"])

        kind = self.entries.schema["vec"].dataType.simpleString()
        right = self.entries.select("row", "vec_id", "vec", "cell").mapInArrow(
            deal, f"vec_id bigint, vec {kind}, cell bigint, shard bigint"
        )
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

        arrow = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def tile(q: pa.Table, v: pa.Table) -> pa.Table:
            if not q.num_rows or not v.num_rows:
                return arrow.empty_table()
            first = size.first_cell[q["shard"][0].as_py()]
            bits = np.frombuffer(b"".join(q["cells"].to_pylist()), dtype=np.uint8).reshape(q.num_rows, -1)
            place = v["cell"].to_numpy() - first
            ids = q["query_id"].to_numpy()
            number, found, score = best_of_shard(
                ids,
                _rows(_column(q, "query")),
                v["vec_id"].to_numpy(),
                _rows(_column(v, "vec")),
                lambda some: np.unpackbits(bits[some], axis=1)[:, place].astype(bool),
                k,
            )
            return pa.table([q["query_row"].to_numpy()[number], ids[number], found, score], schema=arrow)

        partial = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(tile, schema)
        return _ranked(partial, k)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class _Shards:
    """Neighbouring cells with about ``SHARD_ENTRIES`` entries together; a cell
    with more is a run of shards of its own, over which its entries are dealt."""

    def __init__(self, counts: np.ndarray):
        large = counts > SHARD_ENTRIES
        # a new group starts at each large cell, after it, and where the small ones fill a shard
        filled = np.cumsum(np.where(large, 0, counts)) // SHARD_ENTRIES
        starts = np.ones(len(counts), dtype=bool)
        starts[1:] = large[1:] | large[:-1] | (np.diff(filled) > 0)
        group = np.cumsum(starts) - 1
        pieces = np.maximum(1, -(-counts[starts] // SHARD_ENTRIES)) * large[starts] + ~large[starts]
        after = np.cumsum(pieces)
        self.pieces, self.shard = pieces[group], (after - pieces)[group]
        self.first_cell = np.repeat(np.flatnonzero(starts), pieces)
        self.n_cells = np.repeat(np.diff(np.append(np.flatnonzero(starts), len(counts))), pieces)
        self.held = counts > 0

    def of(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        spread = mixed(rows.astype(np.uint64)) % self.pieces[cells].astype(np.uint64)
        return self.shard[cells] + spread.astype(np.int64)

    def asked(self, cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, a bit for each of its cells) of the shards that hold entries of the cells."""
        cells = np.sort(cells[self.held[cells]])
        first = self.shard[cells]
        for shard, part in zip(np.unique(first).tolist(), np.split(cells, np.flatnonzero(np.diff(first)) + 1)):
            bits = np.zeros(self.n_cells[shard], dtype=np.uint8)
            bits[part - self.first_cell[shard]] = 1
            packed = np.packbits(bits).tobytes()
            for piece in range(self.pieces[part[0]]):
                yield shard + piece, packed


def _sampled(entries: DataFrame, n: int, size: int, salt: str) -> DataFrame:
    """About ``size`` of the n rows, by a hash of the row; all if there are fewer."""
    if n <= size:
        return entries
    share = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 48)) / float(1 << 48)
    return entries.where(share < size / n)


def _filled(rows: DataFrame, width: int) -> DataFrame:
    """Vectors filled up to the width with zeros."""
    zero = F.lit(0).cast(rows.schema["vec"].dataType.elementType)
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(zero, F.lit(width) - F.size("vec"))))


def _matrix_of(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("row", "vec_id", "vec").orderBy("row").toArrow()
    return table["vec_id"].to_numpy(), _rows(_column(table, "vec"))


def vector_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: id not null, vector neither
    null nor zero nor empty, all components finite."""
    vector = F.col(f"`{vector_col}`")
    usable = whole_vector(vector) & F.exists(vector, lambda x: x != 0)
    return rows.where(F.col(f"`{id_col}`").isNotNull() & usable).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vector.alias("vec"))


def build_index(vectors: DataFrame, k: int = 5, recall: float = 0.97) -> MultiIndex:
    """An index over ``vectors`` (vec_id, vec; see ``vector_rows``), whose
    search finds about this share of the k nearest; with a recall of 1 or more
    every cell is visited and the search is exact.

    All vectors have the width of the longest one; missing components of a
    shorter one count as 0. Rows that repeat an id are entries each. Of equal
    vectors those of the k + 1 smallest ids are listed: no other copy can be
    among the k nearest. An empty table gives an index that finds nothing.
    The centroids come from a sample of ``SAMPLE_COMPONENTS`` components, the
    budget from ``MEASURED_QUERIES`` vectors; every vector is listed.
    """
    spark = vectors.sparkSession
    stored = written(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = stored.agg(F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if size[0] is None:
        return MultiIndex(stored, None, np.zeros(0, dtype=np.int64), 0, 0)
    width = max(2, size[0])
    stored = _filled(stored, width)
    copies = Window.partitionBy("vec").orderBy("vec_id")
    stored = written(stored.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "distinct-vectors")
    n = stored.count()
    _, sample = _matrix_of(_sampled(stored, n, max(1, SAMPLE_COMPONENTS // width), "fit"))
    centroids = min(MOST_CENTROIDS, max(1, round(math.sqrt(n / CELL_ENTRIES))))
    unit, cut = units(sample), width // 2
    books = Codebooks(fitted_centroids(unit[:, :cut], centroids), fitted_centroids(unit[:, cut:], centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = books.cell_of(_rows(batch["vec"])) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["vec"], pa.array(cell, type=pa.int64())], names=["row", "vec_id", "vec", "cell"])

    kind = stored.schema["vec"].dataType.simpleString()
    entries = written(
        stored.select("row", "vec_id", "vec").mapInArrow(assign, f"row bigint, vec_id bigint, vec {kind}, cell bigint"), "entries"
    )
    counts = np.zeros(books.cells, dtype=np.int64)
    for cell, held in entries.groupBy("cell").count().collect():  # MOST_CENTROIDS ** 2 rows at most
        counts[cell] = held
    index = MultiIndex(entries, books, counts, width, n)
    if recall < 1:
        index.budget = _measured_budget(spark, index, n, k, recall)
    return index


def _measured_budget(spark, index: MultiIndex, n: int, k: int, recall: float) -> int:
    """Entries to visit so that this share of the true k nearest of sampled
    vectors is met."""
    ids, queries = _matrix_of(_sampled(index.entries, n, MEASURED_QUERIES, "measure"))
    arrow = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("cell", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_ids, cells = batch["vec_id"].to_numpy(), batch["cell"].to_numpy()
            every = lambda some: np.ones((len(ids[some]), len(vec_ids)), dtype=bool)
            # numbers in the place of ids lead back to the cells
            order = np.argsort(vec_ids, kind="stable")
            number, found, score = best_of_shard(ids, queries, vec_ids[order], _rows(batch["vec"])[order], every, k)
            at = order[np.searchsorted(vec_ids[order], found)]
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(found), pa.array(score), pa.array(cells[at])], schema=arrow)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = index.entries.mapInArrow(scan, "query bigint, vec_id bigint, score double, cell bigint")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "cell")
    wanted: dict[int, list[int]] = {}
    for query, cell in near.collect():  # MEASURED_QUERIES * k rows at most
        wanted.setdefault(query, []).append(cell)
    needed = []
    for query, cells in wanted.items():
        walked = np.array(index.codebooks.walk(queries[query], index.counts, n))
        place = np.empty(index.codebooks.cells, dtype=np.int64)
        place[walked] = np.arange(len(walked))
        needed += np.cumsum(index.counts[walked])[place[cells]].tolist()
    return int(np.quantile(needed, recall, method="higher")) if needed else n
