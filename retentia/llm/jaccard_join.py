"""N-gram Jaccard join of whole texts in size-banded tiles.

Equal shingle sets are one class, and only one document of a class takes part
in the join. Sets are dealt into bands by their size; two similar sets lie in
the same or in neighbouring bands. Similar sets differ in at most D elements,
so if a band's hash space is cut into more than D regions, they agree in the
whole content of some region. Counts of common bits of hashed bitmaps bound
the overlap of sets that agree in a region from above; sets whose bound
suffices are candidates, also between blocks of a region that many sets share,
and groups of candidates make up the tiles: blocks of
sets of one band against blocks of the same or the next one. In a tile the
bound is taken for all pairs, and pairs that pass are decided by intersecting
their sorted arrays. All steps are exact: no link is lost, no pair is sampled.

Inside a tile a pair that is already connected need not be compared, so
thousands of near copies cost about one comparison each.
"""

from __future__ import annotations

import math
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import WordHashes, mixed, shingle_set, word_hashes
from .store import broadcast_if_small, written

#: Width of a size band (largest over smallest size), sets in a tile's side.
BAND_RATIO, BLOCK_SETS = 1.5, 512
#: Bits of the largest bitmap that travels with a candidate.
LARGEST_BITMAP = 8192
#: Sizes of bands are known up to here; a set is never that large.
_MOST = 1 << 40


def largest_difference(size: int, percent: int) -> int:
    """Elements in which a set of this size and a similar one that is not
    smaller can differ: |difference| <= (1 - t) |union| and |union| <= size / t."""
    return (100 - percent) * size // percent


class Bands:
    """Size bands: starts[b] <= size < starts[b + 1]."""

    def __init__(self, percent: int):
        self.percent = percent
        starts, ratio = [1], 100 / percent  # of the sizes of two similar sets at most
        while starts[-1] < _MOST:
            wider = int(starts[-1] * BAND_RATIO) if ratio <= BAND_RATIO else math.ceil(starts[-1] * ratio)
            starts.append(max(starts[-1] + 1, wider))
        self.starts = np.array(starts, dtype=np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def regions(self, band: int) -> int:
        """More regions than two similar sets, the smaller in this band, can
        differ in; some more make common empty regions rarer than needed."""
        d = largest_difference(int(self.starts[band + 1]) - 1, self.percent)
        return d + 2 + d // 10 if d else 1

    def as_larger(self, size: int) -> list[int]:
        """Lower bands that hold sets similar to one of this size."""
        out, b = [], self.of(size) - 1
        while b >= 0 and self.percent * size <= 100 * (int(self.starts[b + 1]) - 1):
            out.append(b)
            b -= 1
        return out


def region_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of (band, region, content) in the set's own band and those where
    it can be the larger of a pair.

    An empty region is left out, unless the set has so few others that a
    similar set could differ from it in all of them."""
    size = len(shingles)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    own, spread, keys = bands.of(size), mixed(shingles), []
    for band in [own, *bands.as_larger(size)]:
        n = bands.regions(band)
        region = ((spread >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(region, kind="stable")
        filled, first = np.unique(region[order], return_index=True)
        content = np.zeros(n, dtype=np.uint64)
        content[filled] = np.add.reduceat(spread[order], first)
        named = mixed(mixed(content) ^ (np.uint64(band) << np.uint64(40) | np.arange(n, dtype=np.uint64)))
        keys.append(named if len(filled) <= largest_difference(size, bands.percent) else named[filled])
    return np.concatenate(keys)


def _described(batches: Iterator[pa.RecordBatch], size: int, percent: int, with_array: bool) -> Iterator[pa.RecordBatch]:
    """The batch's columns but the last, which is the text, then the set's
    size and id, and its shingles or else its bitmap and region keys."""
    known, bands = WordHashes(), Bands(percent)
    for batch in batches:
        sizes, ids, arrays, marks = [], [], [], []
        for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
            shingles = shingle_set(word_hashes(text.as_py() or b"", known), size)
            sizes.append(len(shingles))
            ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            if with_array:
                arrays.append(shingles.tobytes())
            else:
                arrays.append(region_keys(shingles, bands).view(np.int64))
                marks.append(bitmaps([shingles], bitmap_bits(len(shingles))).tobytes())
        columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
        names = [*batch.schema.names[:-1], "size", "set_id"]
        if with_array:
            columns, names = [*columns, pa.array(arrays, pa.binary())], [*names, "shingles"]
        else:
            columns += [pa.array(marks, pa.binary()), pa.array(arrays, pa.list_(pa.int64()))]
            names += ["marks", "keys"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


# --- inside a tile ---------------------------------------------------------------


def bitmap_bits(size: int) -> int:
    """Bits of a set's own bitmap: a power of two, about twice its size."""
    return max(64, min(LARGEST_BITMAP, 1 << int(2 * max(1, size) - 1).bit_length()))


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps cut to ``words`` 64-bit words: halves laid upon each other, as
    if the elements had been hashed to fewer bits."""
    while marks.shape[-1] > words:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] | marks[..., half:]
    return marks


def _near(left, left_sizes, right, right_sizes, percent: int) -> np.ndarray:
    """True for pairs whose bound suffices; bitmaps are folded to the shortest."""
    left, right = ([np.frombuffer(m, dtype=np.uint64) for m in marks] for marks in (left, right))
    words = min(len(m) for m in [*left, *right])
    left, right = (np.stack([folded(m, words) for m in maps]) for maps in (left, right))
    bound = overlap_bounds(left, left_sizes, right, right_sizes)
    return bound * (100 + percent) >= percent * (left_sizes[:, None] + right_sizes[None, :])


def _chains(rows: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Chains through the groups that a symmetric matrix connects."""
    label = np.arange(len(rows))
    while True:
        least = np.where(near, label[None, :], len(rows)).min(axis=1)
        least = np.minimum(least, label)
        if (least == label).all():
            break
        label = least
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return list(zip(rows[order][:-1][same].tolist(), rows[order][1:][same].tolist(), strict=True))


def group_edges(rows: np.ndarray, sizes: np.ndarray, marks: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Chains through the groups that pairs with a sufficient bound connect."""
    return _chains(rows, _near(marks, sizes, marks, sizes, percent))


def cross_edges(left, right, percent: int) -> list[tuple[int, int]]:
    """The same for pairs between two blocks (rows, sizes, marks) only."""
    n = len(left[0])
    near = np.zeros((n + len(right[0]),) * 2, dtype=bool)
    near[:n, n:] = _near(left[2], np.array(left[1]), right[2], np.array(right[1]), percent)
    near[n:, :n] = near[:n, n:].T
    return _chains(np.array([*left[0], *right[0]]), near)


def _candidate_edges(percent: int, block: int):
    """(a, b) from rows (key, row, size, marks) sorted by key: in each block of
    rows that share a key, and between a block and the next, those connected
    by pairs whose bound suffices. Blocks of a key that lie further apart are
    left to ``_far_edges``."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sizes, marks, last = None, [], [], [], None

        def closed() -> list[tuple[int, int]]:
            nonlocal last, rows, sizes, marks
            found = group_edges(np.array(rows), np.array(sizes), marks, percent) if len(rows) > 1 else []
            if last is not None and rows:
                found += cross_edges(last, (rows, sizes, marks), percent)
            last = (rows, sizes, marks) if len(rows) == block else None
            rows, sizes, marks = [], [], []
            return found

        for batch in batches:
            out = []
            for k, row, size, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(rows) == block:
                    out += closed()
                    if k != key:
                        key, last = k, None
                rows.append(row)
                sizes.append(size)
                marks.append(mark)
            yield _edge_batch(out)
        yield _edge_batch(closed())

    return edges


def _far_edges(percent: int):
    """(a, b) of one tile, a block of a key against another or itself: rows of
    different labels (not connected so far) that pairs whose bound suffices
    connect."""

    def edges(tile: pa.Table) -> pa.Table:
        rows, sizes, labels, sides = (tile[c].to_numpy() for c in ("row", "size", "label", "side"))
        marks = tile["marks"].to_pylist()
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1)
        right = right if len(right) else left
        near = _near([marks[i] for i in left], sizes[left], [marks[j] for j in right], sizes[right], percent)
        near &= labels[left][:, None] != labels[right][None, :]
        i, j = np.nonzero(near)
        # one pair for two labels is enough
        _, one = np.unique(np.stack([labels[left][i], labels[right][j]]), axis=1, return_index=True)
        return pa.table({"a": rows[left][i[one]], "b": rows[right][j[one]]})

    return edges


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*pairs, strict=True)) if pairs else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for row, shingles in zip(out, sets, strict=True):
        marks = np.zeros(bits, dtype=bool)
        marks[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(marks)
    return out.view(np.uint64)


def overlap_bounds(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of all overlaps from bit counts: an element on a bit that
    the other set lacks is no common element, and each such bit has one."""
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for word in range(left.shape[1]):
        common += np.bitwise_count(left[:, word, None] & right[None, :, word])
    left_spare = left_sizes - np.bitwise_count(left).sum(axis=1, dtype=np.int64)
    right_spare = right_sizes - np.bitwise_count(right).sum(axis=1, dtype=np.int64)
    return common + np.minimum(left_spare[:, None], right_spare[None, :])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def tile_links(rows, sets, sides, percent: int, all_links: bool) -> list[tuple[int, int, int]]:
    """(row, row, overlap) of linked pairs between side 0 and side 1, or
    within side 0 if there is no side 1. Without ``all_links`` pairs that are
    connected already are passed over."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = max(64, 1 << int(np.ceil(np.log2(2 * max(1, int(sizes.max(initial=1)))))))
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1)
    within = not len(right)
    right = left if within else right
    maps = bitmaps(sets, min(bits, 1 << 16))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for start in range(0, len(left), 64):
        part = left[start : start + 64]
        bound = overlap_bounds(maps[part], sizes[part], maps[right], sizes[right])
        passed = bound * (100 + percent) >= percent * (sizes[part][:, None] + sizes[right][None, :])
        if within:
            passed &= right[None, :] > part[:, None]
        for i, j in zip(*np.nonzero(passed), strict=True):
            x, y = int(part[i]), int(right[j])
            if not all_links and root(x) == root(y):
                continue
            common = overlap(sets[x], sets[y])
            if common * (100 + percent) >= percent * int(sizes[x] + sizes[y]):
                out.append((rows[x], rows[y], common))
                parent[root(x)] = root(y)
    return out


# --- the join -------------------------------------------------------------------------


class JaccardJoin:
    """Similar documents of a table.

    ``docs``: any table with an integer id and a text column; other columns
    are not looked at. Words are split at ASCII white space, A-Z in lower
    case; a set is the text's distinct runs of ``words`` words, or its whole
    sequence if it has fewer. A null, empty or blank text has no set and no
    links. Rows that repeat an id or a text are rows like any other; a null id
    stays null and is never a component's name, unless no member has an id.
    An empty table gives empty results. Two documents are linked when
    100 * |intersection| >= percent * |union|.
    """

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.words, self.percent = words, percent
        self.texts = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.xxhash64(f"`{text_col}`").alias("text_hash"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        )
        describe = lambda batches: _described(batches, words, percent, False)
        #: one row per document: row, doc_id, text_hash, size, set_id, marks, keys
        self.sets = written(
            self.texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text").mapInArrow(
                describe, "row long, doc_id long, text_hash long, size long, set_id binary, marks binary, keys array<long>"
            ),
            "shingle_sets",
        )
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash", "size")
        #: one row per class of equal sets: set_id and its first document
        self.classes = written(
            self.sets.where(F.col("set_id").isNotNull())
            .groupBy("set_id")
            .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("members"))
            .select("set_id", "first.row", "first.doc_id", "first.text_hash", "first.size", "members"),
            "shingle_classes",
        )

    def candidates(self) -> DataFrame:
        """(a, b): first rows of classes that agree in a region and whose
        bitmaps leave a sufficient overlap possible, enough of them to connect
        all such classes."""
        copied = self.classes.where("members > 1").select("set_id", F.col("row").alias("first_row"))
        copies = written(
            self.sets.join(broadcast_if_small(written(copied, "copied")), "set_id")
            .where(F.col("row") != F.col("first_row"))
            .select("row"),
            "copies",
        )
        firsts = self.sets.join(broadcast_if_small(copies), "row", "left_anti")
        keys = firsts.select(F.explode("keys").alias("key"), "row")
        # most keys have one row: a look at the neighbours in order finds the others, however many share a key
        order = Window.partitionBy("key").orderBy("row")
        shared = written(
            keys.withColumn("before", F.lag("row").over(order))
            .withColumn("after", F.lead("row").over(order))
            .where(F.col("before").isNotNull() | F.col("after").isNotNull())
            .select("key", "row"),
            "shared_keys",
        )
        described = shared.join(self.sets.select("row", "size", "marks"), "row")
        near = (
            described.repartition("key")
            .sortWithinPartitions("key", "row")
            .select("key", "row", "size", "marks")
            .mapInArrow(_candidate_edges(self.percent, BLOCK_SETS), "a long, b long")
            .distinct()
        )
        wide = written(shared.groupBy("key").count().where(F.col("count") > 2 * BLOCK_SETS).select("key"), "wide_keys")
        return near if wide.isEmpty() else self._with_far(shared, wide, near)

    def _with_far(self, shared: DataFrame, wide: DataFrame, near: DataFrame) -> DataFrame:
        """Candidate edges and those between any two blocks of a wide key. Its
        rows are dealt into blocks by what ``near`` connects, so that most
        blocks of many near copies hold one label and need no comparison."""
        labels = components(near, "near_groups").select(F.col("node").alias("row"), F.col("component").alias("label"))
        order = Window.partitionBy("key").orderBy("label", "row")
        rows = written(
            shared.join(broadcast_if_small(wide), "key")
            .join(labels, "row", "left")
            .withColumn("label", F.coalesce("label", "row"))
            .withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK_SETS)),
            "wide_rows",
        )
        blocks = written(
            rows.groupBy("key", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")), "wide_blocks"
        )
        other = blocks.select("key", F.col("block").alias("high"), F.col("least").alias("least_2"), F.col("most").alias("most_2"))
        pairs = (
            blocks.withColumnRenamed("block", "low")
            .join(other, "key")
            .where((F.col("low") <= F.col("high")) & (F.least("least", "least_2") < F.greatest("most", "most_2")))
        )
        sides = pairs.select(
            "key",
            "low",
            "high",
            F.inline(
                F.when(F.col("low") == F.col("high"), F.array(F.struct(F.col("low").alias("block"), F.lit(0).alias("side")))).otherwise(
                    F.array(
                        F.struct(F.col("low").alias("block"), F.lit(0).alias("side")),
                        F.struct(F.col("high").alias("block"), F.lit(1).alias("side")),
                    )
                )
            ),
        )
        far = (
            rows.join(self.sets.select("row", "size", "marks"), "row")
            .join(sides, ["key", "block"])
            .select("key", "low", "high", "side", "row", "size", "label", "marks")
            .groupBy("key", "low", "high")
            .applyInArrow(_far_edges(self.percent), "a long, b long")
        )
        return labels.select(F.col("row").alias("a"), F.col("label").alias("b")).unionByName(far.distinct())

    def _tiles(self, groups: DataFrame) -> DataFrame:
        """(tile columns, side, row) for rows (row, size, component)."""
        bands = Bands(self.percent)
        starts = F.array(*(F.lit(int(s)).cast("long") for s in bands.starts))
        band = F.size(F.filter(starts, lambda s: s <= F.col("size"))) - 1
        rows = written(groups.withColumn("band", band), "tile_rows")
        blocks = rows.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks"))
        blocks = written(blocks, "tile_blocks")
        upper = blocks.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
        lower = blocks.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
        rows = (
            rows.join(blocks, ["component", "band"])
            .join(upper, ["component", "band"], "left")
            .join(lower, ["component", "band"], "left")
            .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
        )
        tile = lambda low_band, low, high_band, high, side: F.struct(
            low_band.cast("int").alias("low_band"),
            low.cast("long").alias("low"),
            high_band.cast("int").alias("high_band"),
            high.cast("long").alias("high"),
            F.lit(side).alias("side"),
        )
        b, k = F.col("band"), F.col("block")
        upto = lambda n: F.when(n.isNull(), F.array().cast("array<bigint>")).otherwise(
            F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1)
        )
        # within the band: the lower block is side 0, the higher one side 1
        own = F.transform(
            upto(F.col("blocks")),
            lambda x: F.when(x < k, tile(b, x, b, k, 1)).otherwise(tile(b, k, b, x, 0)),
        )
        as_low = F.transform(upto(F.col("above")), lambda x: tile(b, k, b + 1, x, 0))
        as_high = F.transform(upto(F.col("below")), lambda x: tile(b - 1, x, b, k, 1))
        return rows.select("component", "row", F.explode(F.concat(own, as_low, as_high)).alias("tile")).select(
            "component", "row", "tile.*"
        )

    def links(self, all_links: bool = True) -> DataFrame:
        """(a, b, overlap): linked first rows of classes; all pairs, or enough
        of them to connect every component."""
        words, percent = self.words, self.percent
        groups = components(self.candidates(), "candidate_groups").select(
            F.col("node").alias("row"), F.col("component")
        )
        members = written(
            groups.join(self.classes.select("row", "doc_id", "text_hash", "set_id", "size"), "row"), "candidate_rows"
        )
        tiles = self._tiles(members.select("row", "size", "component"))
        # the shingles of candidates only, made again from their texts
        wanted = broadcast_if_small(members.select("text_hash"))
        describe = lambda batches: _described(batches, words, percent, True)
        arrays = (
            self.texts.join(wanted, "text_hash", "left_semi")
            .select("doc_id", "text_hash", "text")
            .mapInArrow(describe, "doc_id long, text_hash long, size long, set_id binary, shingles binary")
            .select("set_id", "shingles")
        )
        arrays = written(
            arrays.join(members.select("set_id", "row"), "set_id").dropDuplicates(["row"]).select("row", "shingles"),
            "candidate_shingles",
        )

        def join_tile(group: pa.Table) -> pa.Table:
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"].to_pylist()]
            sides = group["side"].to_numpy()
            low = group["low"][0].as_py(), group["low_band"][0].as_py()
            if low != (group["high"][0].as_py(), group["high_band"][0].as_py()) and not (sides == 1).any():
                return pa.table({"a": [], "b": [], "overlap": []}, schema=schema)
            found = tile_links(group["row"].to_pylist(), sets, sides, percent, all_links)
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

        schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "overlap")])
        place = ["component", "low_band", "low", "high_band", "high"]
        return tiles.join(arrays, "row").groupBy(*place).applyInArrow(join_tile, "a long, b long, overlap long")

    def result(self) -> DataFrame:
        """Per document: row, doc_id, text_hash, size (of its set), group_row,
        component_id (the smallest id it is connected with, itself included)."""
        groups = components(self.links(all_links=False).select("a", "b"), "link_components").select(
            F.col("node").alias("row"), F.col("component").alias("group_row")
        )
        classes = self.classes.join(groups, "row", "left").withColumn("group_row", F.coalesce("group_row", "row"))
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        names = classes.groupBy("group_row").agg(F.min(place).alias("first"))
        named = classes.join(names, "group_row").select(
            "set_id", F.col("first.row").alias("group_row"), F.col("first.doc_id").alias("component_id")
        )
        docs = self.sets.select("row", "doc_id", "text_hash", "size", "set_id")
        return docs.join(named, "set_id", "left").select(
            "row",
            "doc_id",
            "text_hash",
            "size",
            F.coalesce("group_row", "row").alias("group_row"),
            F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )


def keep_one_per_group(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but of each component
    only the document with the smallest id. Rows that agree in id and text
    stay or go together. Null and empty texts belong to no group, so they
    stay; a null id is larger than any other; an empty table stays empty;
    columns may have any names."""
    done = written(JaccardJoin(docs, words, percent, id_col, text_col).result(), "groups")
    stays = done.where(F.col("row") == F.col("group_row")).select("doc_id", "text_hash")
    goes = done.where(F.col("row") != F.col("group_row")).select("doc_id", "text_hash")
    gone = written(goes.subtract(stays), "dropped")
    names = docs.columns
    # names that no column of the input has
    text_hash, gone_id, gone_text = (f"{n}_{max(names, key=len)}" for n in ("text_hash", "gone_id", "gone_text"))
    marked = docs.withColumn(text_hash, F.xxhash64(f"`{text_col}`"))
    gone = broadcast_if_small(gone.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)))
    same = marked[f"`{id_col}`"].cast("long").eqNullSafe(F.col(f"`{gone_id}`")) & (F.col(f"`{text_hash}`") == F.col(f"`{gone_text}`"))
    return marked.join(gone, same, "left_anti").select(*[f"`{n}`" for n in names])
