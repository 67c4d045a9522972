"""Exact top-k search by inner product.

Queries and vectors are dealt into blocks and shards of bounded size. Each
tile (one block, one shard) is one matrix product, which keeps the k best of
its shard for every query; the partial lists of a query are then merged level
by level, a few shards at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES = 1024
SHARD_VECTORS = 4096
FAN_IN = 16


def whole_vector(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of an int64 matrix; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _largest(matrix: np.ndarray) -> float:
    return float(np.abs(matrix.astype(np.float64)).max(initial=0.0))


def tile_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave their 53
    bits, else in integers."""
    if _largest(queries) * _largest(vectors) * max(1, queries.shape[1]) < 2.0**52:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def best_of_tile(query_ids, queries, vec_ids, vectors, k: int):
    """(query_id, vec_id, score) of each query's k best other vectors, ties to
    the smaller id."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[order], vectors[order]
    scores = tile_scores(queries, vectors)
    n = len(vec_ids)
    own = query_ids[:, None] == vec_ids[None, :]  # several, if rows share an id
    take = min(n, k)
    if take < n and float(np.abs(scores.astype(np.float64)).max(initial=0)) * n < 2.0**62:
        rank = scores * n + (n - 1 - np.arange(n))  # no two are equal
        rank[own] = np.iinfo(np.int64).min
        chosen = np.argpartition(rank, n - take, axis=1)[:, n - take :]
    else:
        # ~x falls as x grows, for every integer; ties stay in the order of ids
        chosen = np.lexsort((~scores, own), axis=1)[:, :take]
    rows = np.repeat(np.arange(len(query_ids)), take)
    cols = chosen.ravel()
    keep = ~own[rows, cols]
    rows, cols = rows[keep], cols[keep]
    return query_ids[rows], vec_ids[cols], scores[rows, cols]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    n_vectors: int | None = None,
    n_queries: int | None = None,
    block_queries: int = BLOCK_QUERIES,
    shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """The k best vectors of every query: query_id, rank (from 1), vec_id, score.

    Both frames have (vec_id long, vec array<long>) without nulls (see
    ``vector_table``). A query's own id is no candidate. Rows that share an id
    are candidates each; queries that share an id share one list. Score: the
    inner product; missing components of a shorter vector count as 0. Ties go
    to the smaller vec_id. With fewer than k candidates all are returned; an
    empty side gives an empty result.
    """
    n_vectors = vectors.count() if n_vectors is None else n_vectors
    n_queries = queries.count() if n_queries is None else n_queries
    shards = max(1, math.ceil(n_vectors / shard_vectors))
    blocks = max(1, math.ceil(n_queries / block_queries))
    left = queries.select(
        F.col("vec_id").alias("query_id"),
        F.col("vec").alias("query"),
        F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    right = vectors.select(
        "vec_id",
        F.col("vec").alias("vector"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
    )
    schema = "query_id long, shard long, vec_id long, score long"
    arrow = pa.schema([(n, pa.int64()) for n in ("query_id", "shard", "vec_id", "score")])

    def tile(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return arrow.empty_table()
        width = max(pc.max(pc.list_value_length(x)).as_py() for x in (q["query"], v["vector"]))
        ids, found, score = best_of_tile(
            q["query_id"].to_numpy(), _matrix(q["query"], width), v["vec_id"].to_numpy(), _matrix(v["vector"], width), k
        )
        shard = np.full(len(ids), v["shard"][0].as_py())
        return pa.table([ids, shard, found, score], schema=arrow)

    partial = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(tile, schema)
    groups = shards
    while True:
        groups = math.ceil(groups / FAN_IN)
        partial = partial.withColumn("shard", F.floor(F.col("shard") / FAN_IN) if groups > 1 else F.lit(0).cast("long"))
        best = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        partial = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if groups == 1:
            return partial.select("query_id", "rank", "vec_id", "score")
        partial = partial.drop("rank")


def vector_table(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, vec) of the rows that take part: id not null, vector whole.
    Rows that repeat an id all take part."""
    return rows.where(F.col(f"`{id_col}`").isNotNull() & whole_vector(F.col(f"`{vector_col}`"))).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled(F.col(f"`{vector_col}`"), scale).alias("vec")
    )
