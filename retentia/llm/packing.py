"""Sequence packing by non-negative least squares.

A document's tokens are cut into full windows and a remainder shorter than a
window. Remainders are counted by length class (multiples of UNIT tokens).
All combinations of up to three classes that fill a window are columns of a
non-negative least-squares problem against that histogram; its solution,
rounded down to whole repeats that the histogram can supply, says how many
sequences of each combination there are. What is left over is packed greedily:
laid end to end and cut at window bounds, on multiples of UNIT.

The histogram, the problem and the plan depend on window and unit only, never
on the number of documents. Documents find their place by a rank within their
class, counted in hashed buckets, so that a class that holds a third of all
documents is still counted in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary
from .crc import crc_after
from .store import shuffle_width, written

WINDOW, UNIT, END_ID = 2048, 16, 1


# --- the plan, from a histogram of class sizes -------------------------------


def combinations(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` classes 1..units that add up to ``units``,
    larger classes first."""

    def grow(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                if first * parts >= left:
                    for rest in grow(left - first, first, parts - 1):
                        yield (first, *rest)

    return list(grow(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and
    Hanson on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds or 3 * n):
        slope = target - gram[:, free] @ x[free] if free.any() else target.copy()
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            try:
                tried = np.linalg.solve(gram[np.ix_(at, at)], target[at])
            except np.linalg.LinAlgError:
                tried = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (tried > 0).all():
                x[:] = 0
                x[at] = tried
                break
            low = tried <= 0
            step = min(1.0, float(np.min(x[at][low] / np.maximum(x[at][low] - tried[low], 1e-300))))
            x[at] += step * (tried - x[at])
            gone = at[low & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[low][:1]
            x[gone], free[gone] = 0.0, False
            if not free.any():
                break
    return x


def packing_plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): whole repeats that the histogram can supply."""
    columns = [c for c in combinations(units) if all(histogram.get(x, 0) for x in c)]
    if not columns:
        return []
    a = np.zeros((units, len(columns)))
    for j, c in enumerate(columns):
        for x in c:
            a[x - 1, j] += 1
    b = np.array([histogram.get(x, 0) for x in range(1, units + 1)], dtype=float)
    solved = nnls(a, b)
    left, plan = dict(histogram), []
    for j in np.argsort(-solved, kind="stable"):
        need = {x: columns[j].count(x) for x in columns[j]}
        repeats = min(int(solved[j] + 0.5), *(left.get(x, 0) // n for x, n in need.items()))
        if repeats > 0:
            plan.append((columns[j], repeats))
            for x, n in need.items():
                left[x] -= n * repeats
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, from rank, to rank, first sequence, place): documents of a class
    with ranks in [from, to) go to successive sequences from the first on."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for combination, repeats in plan:
        for place, x in enumerate(combination):
            start = used.get(x, 0)
            slots.append((x, start, start + repeats, sequence, place))
            used[x] = start + repeats
        sequence += repeats
    return slots


# --- tokens --------------------------------------------------------------------


def token_table(docs: DataFrame, id_col: str, text_col: str, window: int, unit: int, end_id: int, vocab: str) -> DataFrame:
    """doc_id, row, n_tokens, windows (CRC of each full window), tail (CRC of
    the remainder's first unit, first two units, ... and of all of it)."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoding(vocab)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64())]
            + [("windows", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]
        )
        for batch in batches:
            ids, rows, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, row, text in zip(ids, rows, batch.column(2), strict=True):
                tokens = np.append(encoder.encode_to_numpy(text.as_py() or "", disallowed_special=()), end_id).astype("<u4")
                n, data = len(tokens), memoryview(tokens.tobytes())
                full = n // window * window
                windows = [zlib.crc32(data[4 * a : 4 * (a + window)]) for a in range(0, full, window)]
                tail, crc = [], 0
                for a in range(full, n, unit):
                    crc = zlib.crc32(data[4 * a : 4 * (a + unit)], crc)
                    tail.append(crc)
                found.append({"doc_id": i, "row": row, "n_tokens": n, "windows": windows, "tail": tail})
                if len(found) == 2000:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return (
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{text_col}`").alias("text"),
        )
        .mapInArrow(tokenized, "doc_id long, row long, n_tokens long, windows array<long>, tail array<long>")
    )


# --- numbering in parallel -----------------------------------------------------


def _running(rows: DataFrame, keys: list[str], amount: Column, name: str, buckets: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows before, per
    ``keys``; rows are ordered by hashed bucket, then row number."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).withColumn("amount", amount.cast("long"))
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("amount").alias("in_bucket"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and bucket, however many documents there are
    bases = sums.select(*keys, "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("amount").over(inside), F.lit(0)))
        .join(bases, [*keys, "bucket"])
        .withColumn(name, F.col("base") + F.col("inside"))
        .drop("bucket", "amount", "inside", "base")
    )


def _cut(unit: int, units: int):
    """Pieces of left-over remainders laid end to end from ``place`` (in
    units): one that crosses a window's bound is cut there."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, n_tokens, first, length, place, tail = (batch.column(i) for i in range(6))
            first, length, place = (c.to_numpy() for c in (first, length, place))
            size = -(-length // unit)
            room = units - place % units
            crossing = room < size
            head_units = np.where(crossing, room, size)
            flat, ends = tail.flatten().to_numpy().astype(np.uint32), np.cumsum(np.asarray(tail.value_lengths(), dtype=np.int64))
            starts = ends - size
            head_crc = flat[starts + head_units - 1]
            head_length = np.where(crossing, head_units * unit, length)
            rest = np.flatnonzero(crossing)
            rest_length = length[rest] - head_length[rest]
            rest_crc = crc_after(flat[ends[rest] - 1], head_crc[rest], 4 * rest_length)
            take = pa.array(np.concatenate([np.arange(len(length)), rest]))
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id.take(take),
                    n_tokens.take(take),
                    pa.array(np.concatenate([first, first[rest] + head_length[rest]])),
                    pa.array(np.concatenate([head_length, rest_length])),
                    pa.array(np.concatenate([head_crc, rest_crc]).astype(np.int64)),
                    pa.array(np.concatenate([place // units, place[rest] // units + 1])),
                    pa.array(np.concatenate([place % units, np.zeros(len(rest), dtype=np.int64)])),
                ],
                names=["doc_id", "n_tokens", "start", "length", "ids_crc32", "sequence_id", "place"],
            )

    return pieces


_PIECE = "doc_id long, n_tokens long, start long, length long, ids_crc32 long, sequence_id long, place long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    unit: int = UNIT,
    end_id: int = END_ID,
    vocab: str = vocabulary.JSON_FILE,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is the end id alone. A null id stays null; repeated
    rows are packed once each. An empty table gives an empty result; other
    columns are not looked at. Texts of any length are cut into full windows.
    """
    spark = docs.sparkSession
    units, buckets = window // unit, max(8, shuffle_width(spark))
    tokens = written(token_table(docs, id_col, text_col, window, unit, end_id, vocab), "tokens")
    full = F.col("n_tokens") - F.col("n_tokens") % window
    rest = tokens.where(F.col("n_tokens") % window > 0).select(
        "doc_id",
        "row",
        "n_tokens",
        full.alias("start"),
        (F.col("n_tokens") % window).alias("length"),
        F.ceil((F.col("n_tokens") % window) / unit).cast("int").alias("class"),
        F.element_at("tail", -1).alias("ids_crc32"),
    )
    # at most window / unit classes
    histogram = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(histogram, units)
    planned = sum(repeats for _, repeats in plan)
    slots = spark.createDataFrame(
        plan_slots(plan), "slot_class int, from_rank long, to_rank long, first_sequence long, place long"
    )
    in_slot = (
        (F.col("class") == F.col("slot_class"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank"))
    )
    ranked = written(
        _running(rest, ["class"], F.lit(1), "rank", buckets).join(F.broadcast(slots), in_slot, "left"), "ranked"
    )
    in_plan = ranked.where(F.col("first_sequence").isNotNull()).select(
        "doc_id",
        "n_tokens",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        "place",
    )
    left_over = ranked.where(F.col("first_sequence").isNull()).select(
        "doc_id", "row", "n_tokens", "start", "length", "class"
    )
    left_units = sum(n * c for c, n in histogram.items()) - planned * units
    cut = (
        _running(left_over, [], F.col("class"), "at", buckets)
        .join(tokens.select("row", "tail"), "row")
        .select("doc_id", "n_tokens", "start", "length", "at", "tail")
        .mapInArrow(_cut(unit, units), _PIECE)
        .withColumn("sequence_id", F.col("sequence_id") + F.lit(planned))
    )
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    short = in_plan.unionByName(cut).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    numbered = _running(
        tokens.where(F.size("windows") > 0).select("doc_id", "row", "n_tokens", "windows"),
        [],
        F.size("windows"),
        "before",
        buckets,
    )
    full_windows = numbered.select(
        "doc_id", "n_tokens", "before", F.posexplode("windows").alias("at", "ids_crc32")
    ).select(
        "doc_id",
        (F.col("at").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        (F.col("before") + F.col("at") + F.lit(planned - (-left_units // units))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "n_tokens",
    )
    names = ["doc_id", "start", "length", "ids_crc32", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset"]
    return short.select(*names).unionByName(full_windows.select(*names))
