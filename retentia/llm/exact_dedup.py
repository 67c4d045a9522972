"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary finds the digests that many rows share. Their exact
counts and winners are verified against the digest table and broadcast, so
that their rows are decided map-side; all other digests go through one
ordinary shuffle, in which no group can be much larger than a partition.

Only (id, digest, row number) travel: texts are read once to be hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_width, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _merge(counters: dict, more: dict, k: int) -> dict:
    """Adds weighted counts to a Misra-Gries summary of k counters: what is
    over k counters pays the (k+1)-th largest count, so a counter is too low
    by total / (k + 1) at most."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > k:
        toll = sorted(counters.values(), reverse=True)[k]
        counters = {key: n - toll for key, n in counters.items() if n > toll}
    return counters


def frequent(keys: DataFrame, k: int) -> DataFrame:
    """(key, estimate) of at most k keys of the one-column frame ``keys``,
    among them every key that more than 2 / (k + 1) of the rows hold.

    Each task keeps k counters. The summaries are added up by key; estimates
    add up to at most the number of rows, so at most k of them exceed
    1 / (k + 1) of it, and a key over 2 / (k + 1) is among those.
    """
    name = keys.columns[0]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            more = dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True))
            counters = _merge(counters, more, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counters), type=pa.binary()), pa.array(list(counters.values()), type=pa.int64())],
            names=[name, "estimate"],
        )

    partial = keys.mapInArrow(summary, f"`{name}` binary, estimate long")
    return partial.groupBy(name).agg(F.sum("estimate").alias("estimate")).orderBy(F.desc("estimate"), name).limit(k)


def _counters(spark) -> int:
    """Enough counters that a group the split leaves to the shuffle holds at
    most half of an average partition; 32-byte keys, so 4,096 partitions make
    a broadcast of about 1 MB."""
    return max(1024, 4 * shuffle_width(spark))


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Of the rows whose texts are equal after white space is normalised, the
    one with the smallest id stays. A null text counts as empty. A null id
    counts as larger than any other, so such a row stays only in a group
    without ids. Rows that repeat an id and a text are a group like any
    other: exactly one of them stays. An empty table gives an empty result;
    other columns of ``docs`` are not looked at.
    """
    return _decided(docs, id_col, text_col, k)[0]


def _decided(docs: DataFrame, id_col: str, text_col: str, k: int | None) -> tuple[DataFrame, DataFrame]:
    """The decisions, and the winners of the frequent digests (at most k rows)."""
    spark = docs.sparkSession
    k = k or _counters(spark)
    # row numbers tell repeated (id, text) rows apart; they are fixed by being written
    table = written(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    rows = table.count()
    candidates = frequent(table.select("digest"), k).select("digest")
    winners = written(
        table.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first"))
        .where(F.col("group_size") > max(1, rows // (k + 1))),
        "winners",
    )  # at most k rows
    heavy = table.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = (
        table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("first", F.min(place).over(group))
    )
    out = [
        F.col("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest"),
    ]
    return heavy.select(*out).unionByName(light.select(*out)), winners


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Same decisions as ``dedup_decisions``. Of rows that agree in id and text
    but not in other columns, any one stays.
    """
    names = docs.columns
    decisions, winners = _decided(docs, id_col, text_col, k)
    # names that no column of the input has
    longest = max(names, key=len)
    digest, key, winner = (f"{n}_{longest}" for n in ("digest", "key", "winner"))
    survivors = decisions.where("kept").select(_identity(F.col("doc_id"), F.col("digest")).alias(key))
    frequent_ids = winners.select(F.col("digest").alias(digest), F.struct("first.id").alias(winner))
    own_id = F.col(f"`{id_col}`")
    rows = docs.withColumn(digest, text_digest(F.col(f"`{text_col}`"))).join(F.broadcast(frequent_ids), digest, "left")
    # copies of frequent texts go here, before any text is shuffled
    rows = rows.where(F.col(f"`{winner}`").isNull() | own_id.eqNullSafe(F.col(f"`{winner}`.id")))
    rows = rows.withColumn(key, _identity(own_id, F.col(f"`{digest}`")))
    return rows.join(survivors, key, "left_semi").dropDuplicates([key]).select(*[f"`{n}`" for n in names])


def _identity(doc_id: Column, digest: Column) -> Column:
    return F.concat(digest, F.encode(F.coalesce(doc_id.cast("string"), F.lit("~")), "UTF-8"))
