"""Exact running sums over distinct values, inside the JVM.

The ranking metrics and the drift statistics scan tables of distinct values
with counts: ``(group..., value, counts...)`` with one row per (group,
value). They need, in value order per group, the running sums of the counts
and the next value. A window over the whole group would put it in one task
(a group may be a single score column holding every row), so the order is
cut into value buckets that Spark can spread:

1. the table is stored once (Parquet in the shared folder);
2. buckets that hold more than 200,000 distinct values are cut, all of them at
   once, into at most ``FAN_OUT`` parts of equal size by a sketch aggregation
   per bucket (``percentile_approx``; its accuracy follows the number of parts,
   never the number of rows). The cuts are a stored table with a row per bucket
   that is cut. This is repeated on the parts until every bucket fits: a tree
   of cut points, of which the driver sees the size of the largest bucket only;
3. each row joins the cuts of its bucket and finds its part by binary search
   (one fold over the step widths). Every reader and every retried task reads
   the same stored cuts, so assigns the same buckets;
4. a window per (group, bucket) gives the running sums, the row number and
   the next value inside the bucket;
5. per (group, bucket) totals and first values (one row per bucket, taken
   from the stored table before the window) give each bucket's offsets and
   the next bucket's first value, joined back on (group, bucket). They are
   summed along the tree: inside each bucket of the first level, then over
   those.

No Python, no size-dependent second method. Values must be unique within a
group, not null and not NaN (callers aggregate to distinct values first).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

# Fixed parameters: distinct values per bucket that a window task handles
# comfortably, parts that a bucket is cut into, the least sketch accuracy, and
# the cut buckets whose cuts are broadcast (8 KB each at most).
BUCKET_ROWS = 200_000
FAN_OUT = 1_024
SKETCH_ACCURACY = 10_000
BROADCAST_CUTS = 1_024
BUCKET, FIRST_LEVEL = "_vbucket", "_vfirst"
CUTS = "_vcuts"


def _bucket_of(value: Column, cuts: Column, longest: int) -> Column:
    """Binary search: the number of cut points <= value (cut points are
    sorted). One fold over the step widths; the running position is a
    lambda variable, so the expression stays small."""
    widths = []
    w = 1
    while w * 2 <= longest:
        w *= 2
    while w >= 1:
        widths.append(w)
        w //= 2

    def step(pos: Column, width: Column) -> Column:
        probe = F.try_element_at(cuts, (pos + width).cast(T.IntegerType()))
        return F.when((pos + width <= F.size(cuts)) & (probe <= value), pos + width).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(x) for x in widths]), F.lit(0), step)


def _largest(bucketed: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest bucket: one number."""
    sizes = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def _bucketed(df: DataFrame, value: str, group_by: Sequence[str]) -> DataFrame:
    """``df`` with ``BUCKET``, whose order is that of the values in a group,
    and ``FIRST_LEVEL``, the bucket's ancestor in the first level of cuts."""
    keys = [*group_by, BUCKET]
    v = F.col(value).cast(T.DoubleType())
    # always 0, but no constant: joins on it stay joins on a key
    root = F.pmod(F.xxhash64(value), F.lit(1).cast(T.LongType()))
    out = df.withColumn(BUCKET, root).withColumn(FIRST_LEVEL, F.col(BUCKET))
    largest, level = _largest(out, keys), 0
    while largest > BUCKET_ROWS:
        parts = 2
        while parts < FAN_OUT and parts * BUCKET_ROWS < largest:
            parts *= 2
        if level:  # two levels are enough for 10**11 values; the table is read again for each
            out = stored(out, "value_buckets")
        sketch = F.percentile_approx(v, [i / parts for i in range(1, parts)], max(SKETCH_ACCURACY, 10 * parts))
        cuts = stored(
            out.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), sketch.alias(CUTS))
            .where(F.col("_n") > BUCKET_ROWS)
            .drop("_n"),
            "value_cuts",
        )
        cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_CUTS else cuts
        part = F.coalesce(_bucket_of(v, F.col(CUTS), parts - 1), F.lit(0))
        out = out.join(cuts, keys, "left").withColumn(BUCKET, F.col(BUCKET) * parts + part).drop(CUTS)
        if not level:
            out = out.withColumn(FIRST_LEVEL, F.col(BUCKET))
        before, largest, level = largest, _largest(out, keys), level + 1
        if largest >= before:  # can't happen to distinct values
            break
    return out


def _offsets(totals: DataFrame, group_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group..., BUCKET, ``_off_<column>``, ``_next_first``) of bucket totals
    with their first value: sums over all earlier buckets of the group."""
    group = [F.col(g) for g in group_by] or [F.lit(0)]

    def sums(window: Window, names: Sequence[str]) -> list[Column]:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in names]

    inner = Window.partitionBy(*group, FIRST_LEVEL).orderBy(BUCKET)
    outer = Window.partitionBy(*group).orderBy(FIRST_LEVEL)
    above = totals.groupBy(*group_by, FIRST_LEVEL).agg(F.min("_first").alias("_first"), *[F.sum(c).alias(c) for c in columns])
    above = above.select(
        *group_by,
        FIRST_LEVEL,
        *[c.alias(f"_up_{n}") for c, n in zip(sums(outer, columns), columns)],
        F.lead("_first").over(outer).alias("_up_first"),
    )
    inside = totals.select(
        *group_by,
        FIRST_LEVEL,
        BUCKET,
        *[c.alias(f"_at_{n}") for c, n in zip(sums(inner, columns), columns)],
        F.lead("_first").over(inner).alias("_at_first"),
    )
    return inside.join(above, [*group_by, FIRST_LEVEL]).select(
        *group_by,
        BUCKET,
        *[(F.col(f"_at_{n}") + F.col(f"_up_{n}")).alias(f"_off_{n}") for n in columns],
        F.coalesce("_at_first", "_up_first").alias("_next_first"),
    )


def value_scan(
    df: DataFrame,
    value: str,
    group_by: Sequence[str] = (),
    sums: Sequence[str] = (),
    lead: bool = False,
    rank: str = "_r",
    input_stored: bool = False,
) -> DataFrame:
    """Adds ``rank`` (1-based), ``cum_<s>`` (inclusive running sums) and,
    with ``lead``, ``next_<value>`` (null on a group's last row) in value
    order within each group. Group keys must not be null. ``input_stored``:
    ``df`` is a stored table already."""
    group_by, sums = list(group_by), list(sums)
    # read for the sizes, the cut points, the totals and the scan
    df = df if input_stored else stored(df, "value_counts")
    bucketed = _bucketed(df, value, group_by)

    keys = group_by + [BUCKET]
    inside = Window.partitionBy(*keys).orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    cols = {rank: F.row_number().over(inside).cast(T.LongType())}
    for s in sums:
        cols[f"_in_{s}"] = F.sum(F.coalesce(F.col(s), F.lit(0))).over(running)
    if lead:
        cols["_in_next"] = F.lead(value).over(inside)
    windowed = bucketed.withColumns(cols)
    # one row per (group, bucket): totals, offsets and the next first value
    totals = bucketed.groupBy(*keys, FIRST_LEVEL).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_first"),
        *[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(f"_t_{s}") for s in sums],
    )
    out = windowed.drop(FIRST_LEVEL).join(_offsets(totals, group_by, ["_n", *[f"_t_{s}" for s in sums]]), keys)
    fixes = {rank: F.col(rank) + F.col("_off__n")}
    for s in sums:
        fixes[f"cum_{s}"] = F.col(f"_in_{s}") + F.col(f"_off__t_{s}")
    if lead:
        fixes[f"next_{value}"] = F.coalesce(F.col("_in_next"), F.col("_next_first"))
    drop = [BUCKET, "_off__n", "_next_first", "_in_next"] + [f"_in_{s}" for s in sums] + [f"_off__t_{s}" for s in sums]
    return out.withColumns(fixes).drop(*drop)
