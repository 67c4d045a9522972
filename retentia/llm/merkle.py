"""A Merkle manifest of a dataset: a digest tree per group, a tree over them.

Rows are leaves. In each group the leaves lie in the order of their ids; every
16 digests that follow each other become one, level by level, until one is
left, the group's root. Those, in the order of the groups, become the dataset's
root in the same way.

The manifest is content-addressed: for each height of the trees a stored table
leads from a digest to its children. To prove leaves, requests descend from
the root by the hexadecimal digits of their rank: each step looks the digest
up, takes the child that the next digit names and notes the children it did
not take. Requests with the same digits so far are one row, so that no record
is asked for more than once, and only the last step meets single leaves. The
noted segments, turned round, are the proofs from leaf to root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, written

#: Children of a node: one hexadecimal digit of a rank.
FAN_OUT, DIGIT_BITS = 16, 4
DIGEST_BYTES = 32
_ROWS_OF_TASK_BITS = 33  # of monotonically_increasing_id

PATH_TYPE = "array<struct<before: binary, after: binary>>"


def field_text(column: Column) -> Column:
    """`-` for null, else length in UTF-8 bytes, `:` and the value: fields can
    be laid end to end without a doubt where one ends."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.concat(*map(field_text, fields)), "UTF-8"), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf (32 bytes) and its proof, as hex text."""

    def up(below: Column, step: Column) -> Column:
        text = F.concat(_hex(step["before"]), below, _hex(step["after"]))
        return F.sha2(F.encode(text, "UTF-8"), 256)

    return F.aggregate(proof, _hex(leaf), up)


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows``, stored, with ``number``: the place of each in the given order,
    from 0, and ``part``: the range of the order it lies in.

    Ranges are sorted on their own; the numbers of a range go on from the
    count of all earlier ones, a table with one row per range.
    """
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), name
    )
    placed = placed.withColumn("part", F.shiftright("place", _ROWS_OF_TASK_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row per range
    ranges = ranges.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.col("place").bitwiseAND((1 << _ROWS_OF_TASK_BITS) - 1)
    return placed.join(F.broadcast(ranges), "part").withColumn("number", number).drop("place", "earlier")


def _height(n: Column) -> Column:
    """Levels above n leaves: the hexadecimal digits of the last rank."""
    return F.when(n <= 1, 0).otherwise(F.length(F.hex(n - 1)))


@dataclass
class Manifest:
    """``leaves``: tree, rank, digest and the columns kept, one row per row of
    the dataset. ``groups``: tree, its n leaves, height, digest (its root).
    ``records``: by height (from 1), digest -> children, of the trees of
    groups, and ``top_records`` of the tree over them. ``root``: 32 bytes,
    None for an empty dataset."""

    leaves: DataFrame
    groups: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: bytes | None

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """The columns of ``requests`` (rows of ``leaves``; all by default) with
        subroot and proof: from the leaf's level to the root's, the digests
        before and after the one that comes from below, end to end."""
        asked = self.leaves if requests is None else requests
        spark = self.leaves.sparkSession
        entry = spark.range(1 if self.root else 0).select(
            F.col("id").alias("tree"),
            F.unhex(F.lit((self.root or b"").hex())).alias("digest"),
            F.array().cast(PATH_TYPE).alias("path"),
            F.lit(len(self.top_records)).alias("height"),
        )
        top = self.groups.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), "n", "height", "digest")
        wanted = asked.select("tree").distinct() if requests is not None else None
        if wanted is not None:
            top = top.join(wanted.select(F.col("tree").alias("rank")), "rank", "left_semi")
        found = _descended(entry, self.top_records, top.withColumnRenamed("digest", "subroot"), every=requests is None)
        entry = found.select(F.col("rank").alias("tree"), F.col("subroot").alias("digest"), "subroot", "path", "height")
        entry = written(entry, "paths-to-groups")  # read for each height
        found = _descended(entry, self.records, asked, every=requests is None)
        return found.withColumn("proof", F.reverse("path")).drop("path")


def _climbed(leaves: DataFrame, height: int, name: str) -> list[DataFrame]:
    """(tree, rank, digest, children) of the nodes of each height, stored, of
    trees of up to that height; ``leaves``: tree, rank, n, digest."""
    levels = []
    nodes = leaves.select("tree", "rank", "digest", _height(F.col("n")).alias("above"))
    for h in range(1, height + 1):
        inner = nodes.where(F.col("above") > 0)
        children = F.sort_array(F.collect_list(F.struct("rank", _hex(F.col("digest")).alias("hex"))))  # at most 16
        grouped = inner.groupBy("tree", F.shiftright("rank", DIGIT_BITS).alias("rank"), "above").agg(children.alias("c"))
        joined = grouped.select("tree", "rank", "above", F.array_join("c.hex", "").alias("hex"))
        digest, children = F.unhex(F.sha2(F.encode("hex", "UTF-8"), 256)), F.unhex("hex")
        levels.append(written(joined.select("tree", "rank", "above", digest.alias("digest"), children.alias("children")), f"{name}-{h}"))
        nodes = levels[-1].select("tree", "rank", "digest", (F.col("above") - 1).alias("above"))
    return levels


def _descended(entry: DataFrame, records: list[DataFrame], requests: DataFrame, every: bool) -> DataFrame:
    """The rows of ``requests`` (tree, rank, ...) with the columns of ``entry``
    (tree, height, digest of its root, path, ...), whose path goes on to the
    leaf. ``every``: all leaves are asked for."""
    more = [c for c in entry.columns if c not in ("tree", "height", "digest", "path")]
    digit = F.col("rank").bitwiseAND(FAN_OUT - 1).cast("int")

    def step(children: Column, chosen: Column) -> Column:
        before = F.substring(children, F.lit(1), chosen * DIGEST_BYTES)
        after = F.substring(children, (chosen + 1) * DIGEST_BYTES + 1, F.lit(FAN_OUT * DIGEST_BYTES))
        return F.array(F.struct(before.alias("before"), after.alias("after")))

    lone = entry.where("height = 0").select("tree", F.lit(0).cast("bigint").alias("rank"), "path", *more)
    out = requests.join(lone, ["tree", "rank"])
    moved = None
    for h in range(len(records), 0, -1):
        here = entry.where(F.col("height") == h).select("tree", F.lit(0).cast("bigint").alias("at"), "digest", "path", *more)
        here = here if moved is None else here.unionByName(moved)
        # equal subtrees have one record
        store = records[h - 1].groupBy("digest").agg(F.min("children").alias("children"))
        here = here.join(store, "digest").drop("digest")
        if h == 1:
            asked = requests.withColumn("at", F.shiftright("rank", DIGIT_BITS))
            met = asked.join(here, ["tree", "at"])
            met = met.withColumn("path", F.concat("path", step(F.col("children"), digit))).drop("at", "children")
            out = out.unionByName(met)
            break
        n = F.octet_length("children") / DIGEST_BYTES
        down = here.withColumn("digit", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
        child = F.substring(F.col("children"), F.col("digit") * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))
        moved = down.select(
            "tree",
            (F.col("at") * FAN_OUT + F.col("digit")).alias("at"),
            child.alias("digest"),
            F.concat("path", step(F.col("children"), F.col("digit"))).alias("path"),
            *more,
        )
        if not every:
            prefixes = requests.select("tree", F.shiftright("rank", DIGIT_BITS * (h - 1)).alias("at")).distinct()
            moved = moved.join(prefixes, ["tree", "at"], "left_semi")
    return out


def merkle_manifest(
    rows: DataFrame, fields: Sequence[Column], id_col: str = "doc_id", group_col: str = "source", keep: Sequence[Column] = ()
) -> Manifest:
    """The manifest of ``rows``, whose leaves are the digests of ``fields``.

    Groups lie in the order of their UTF-8 bytes, a null one first; an empty
    name is a group of its own. Inside a group leaves ascend by id, a null id
    first; rows that share an id, by digest, then as they were read. ``keep``:
    aliased columns that the leaves carry, with ``id`` and ``group``. Repeated
    rows are leaves each. An empty table has no root and no proofs. Other
    columns of ``rows`` are not looked at.
    """
    name = F.col(f"`{group_col}`").cast("string")
    leaves = written(
        rows.select(
            F.when(name.isNull(), "").otherwise(F.concat(F.lit("+"), name)).alias("name"),
            F.col(f"`{id_col}`").alias("id"),
            leaf_digest(*fields).alias("digest"),
            *[F.struct(c).alias(f"kept{i}") for i, c in enumerate(keep)],
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    leaves = _numbered(leaves, ["name", "id", "digest", "row"], "leaf-order")
    # a group with many rows lies in many ranges: (group, range) is never a hot key
    spots = leaves.groupBy("name", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = spots.groupBy("name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    groups = _numbered(groups, ["name"], "group-order").withColumnRenamed("number", "tree").drop("part")
    spots = written(spots.select("name", "part").join(groups, "name"), "spots")
    leaves = written(
        leaves.join(broadcast_if_small(spots), ["name", "part"]).select(
            "tree",
            (F.col("number") - F.col("first")).alias("rank"),
            "n",
            F.col("id"),
            F.when(F.col("name") != "", F.substr("name", F.lit(2))).alias("group"),
            "digest",
            *[c for c in leaves.columns if c.startswith("kept")],
        ),
        "ranked-leaves",
    )
    tallest = groups.agg(F.max(_height(F.col("n"))), F.count(F.lit(1)), F.max(_height(F.col("tree") + 1))).first()
    records = _climbed(leaves, tallest[0] or 0, "records")
    # roots: lone leaves, and the nodes that have nothing above them
    roots = leaves.where("n = 1").select("tree", "digest")
    for level in records:
        roots = roots.unionByName(level.where("above = 1").select("tree", "digest"))
    sizes = groups.select("tree", "n", _height(F.col("n")).alias("height"))
    roots = written(sizes.join(roots, "tree"), "group-roots")
    top = roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(tallest[1]).alias("n"), "digest")
    top_records = _climbed(top, tallest[2] or 0, "top-records")
    last = top_records[-1] if top_records else roots
    root = last.select("digest").first()  # one row, or none
    leaves = leaves.select("tree", "rank", "n", "id", "group", "digest", *[f"kept{i}.*" for i in range(len(keep))])
    return Manifest(leaves, roots, records, top_records, bytes(root[0]) if root else None)
