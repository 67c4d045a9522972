"""Many boosted-tree models on one table, grown level by level together.

A search fits every candidate on every fold. Fitted one by one each level of
each tree is a Spark job of its own; here the models share their jobs, in one
of two ways that give the same models to the last bit:

* up to ``WHOLE_ROWS`` rows one job grows them all, a model a task. The packed
  table (21 bytes a row) is broadcast, a task holds some 60 bytes a row;
* a larger table stays distributed: all models grow their t-th tree at the
  same time, and one job a level adds up the gradient histograms of every
  (model, node, feature, bin). The number of jobs is that of the longest model
  (trees x levels), however many models there are. A single model grows like
  this at any size, so that its rows are shared out.

The algorithm is that of ``GBTClassifier``: log loss on labels -1 and 1, the
first tree fitted to the labels with weight 1, the others to the residuals
``4 y / (1 + exp(2 y F))`` with the step size as weight; regression trees on
at most ``max_bins`` bins a feature, cut half way between neighbouring values;
the split with the largest gain in variance; at least ``min_rows`` rows on
either side. Rows are drawn without replacement for each tree, features for
each node. Draws are hashes of (row key, seed, tree). From ``PLAIN_ROWS`` rows
on residuals are rounded to a power of two that is small enough to tell nothing
and large enough for every sum to be exact (``residual_unit``): sums do not
depend on the order of rows, so a model depends on its rows and its seed alone.
Smaller tables add up plain residuals in the order of rows.

A task that grows a whole model takes its rows in chunks that fit a core's
cache. Features are counted jointly, several in one cell number; of two sister
nodes the smaller one is counted, the other one is the rest of their parent
(exact sums allow that; plain ones are added up as in a distributed table).

In a distributed table rows travel in packed blocks with the running scores of
all models. A level reads the blocks, walks the trees so far, and sends one
histogram array per model and task to the reducers, which pick the splits: what
reaches the driver is one number per node. After each tree the blocks with the
new scores are persisted, every few trees checkpointed in the shared folder, so
that a lost executor costs a few trees. This is the one place of the library
that keeps partition state in an RDD.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows up to which a task holds the table and grows whole models, and the
#: depth up to which it does (its joint histograms have 2 ** depth nodes).
WHOLE_ROWS = 8_000_000
WHOLE_DEPTH = 8
#: Rows up to which residuals are not rounded, and equal layouts give equal models.
PLAIN_ROWS = 32_768
#: Rows that such a task takes at a time, and cells of a joint histogram.
CHUNK_ROWS = 32_768
JOINT_CELLS = 1_024
#: Rows of a packed block.
BLOCK_ROWS = 8_192
#: Rows of a task, from which on there are more tasks than run at once.
TASK_ROWS = 200_000
#: Inner nodes of a level up to which rows are compared with every node's cut.
COMPARED_NODES = 16
#: Rows that the bins are cut from; all rows are used to fit.
SAMPLE_ROWS = 100_000
#: Trees between two checkpoints of the running scores.
CHECKPOINT_TREES = 20
#: A gain below this share of the node's sum of squares is rounding.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Boosted:
    """One model: its settings, and the fold it does not train on."""

    trees: int
    step: float
    depth: int
    min_rows: int = 1
    row_share: float = 1.0
    features: int | None = None
    held_out: int | None = None
    seed: int = 0


@dataclass
class Block:
    """Rows of a task: bins (features x rows), labels -1 / 1, folds, hashed
    keys, scores (models x rows), what residuals are rounded to (0: nothing)."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    scores: np.ndarray
    unit: float = 0.0


@dataclass
class Chunk:
    """Rows of one fold in the table that a task holds: bins (features x
    rows), labels -1 / 1, hashed keys."""

    bins: np.ndarray
    label: np.ndarray
    key: np.ndarray
    fold: int


def _hashed(x: np.ndarray) -> np.ndarray:
    """64-bit integers, well mixed (the finalizer of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row, the same wherever the row lies."""
    return (_drawn_bits(key, seed, tree) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _drawn_bits(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    salt = _hashed(np.array([(seed << 20) + tree + 1], dtype=np.uint64))
    return _hashed(key ^ salt)


def _drawn(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Where ``_draw`` is below the share, compared as whole numbers."""
    return _drawn_bits(key, seed, tree) < np.uint64(math.ceil(share * (1 << 53)) << 11)


def residual_unit(rows: int) -> float:
    """The power of two that residuals are rounded to, 0 for a small table.
    They are 4 at most, so their sums over all rows are exact in 53 bits; beyond
    2 ** 23 rows the unit stays at 2 ** -28 and sums are rounded again."""
    return 0.0 if rows <= PLAIN_ROWS else 2.0 ** -max(28, 51 - math.ceil(math.log2(rows)))


def bin_edges(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Cut points of one feature, half way between neighbouring distinct
    values: all of them if they fit. Else, from the smallest value on, one
    where the rows so far come closest to the next multiple of an equal share
    (a value that fills several shares ends one of them only). Missing values
    get a bin of their own, after the largest value."""
    missing = np.isnan(values)
    distinct, counts = np.unique(values[~missing], return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    last = distinct[-1:] if missing.any() else distinct[:0]
    if len(middles) < max_bins:
        return np.append(middles, last)
    share = counts.sum() / max_bins
    cuts, wanted = [], share
    so_far = np.cumsum(counts).tolist()
    for i, (here, further) in enumerate(zip(so_far, so_far[1:])):
        if abs(here - wanted) < abs(further - wanted):
            cuts.append(i)
            wanted += share
    return np.append(middles[cuts], last)


def _edges(df: DataFrame, features: Sequence[str], key: str, rows: int, max_bins: int) -> list[np.ndarray]:
    sample = df
    if rows > SAMPLE_ROWS:  # by a hash of the key: about so many rows
        share = F.pmod(F.xxhash64(key, F.lit("bins")), F.lit(1 << 48)) / float(1 << 48)
        sample = df.where(share < SAMPLE_ROWS / rows)
    table = sample.select(*[F.col(f).cast("double") for f in features]).toArrow()
    # a null counts as the largest value, as a NaN does
    columns = [np.array(table[f].fill_null(np.nan).to_numpy(), dtype=np.float64) for f in features]
    return [bin_edges(c, max_bins) for c in columns]


def _packed(df: DataFrame, features: Sequence[str], label: str, key: str, fold: str | None, edges: list[np.ndarray]) -> DataFrame:
    """The rows in blocks: their number, and the bytes of each array."""
    rows = df.select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, f in enumerate(features)],
        F.col(label).cast("double").alias("label"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
        F.xxhash64(key).alias("key"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                bins = [np.searchsorted(e, part[f"f{i}"].to_numpy(zero_copy_only=False), side="left") for i, e in enumerate(edges)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": pa.array([part.num_rows], type=pa.int32()),
                        "bins": [np.array(bins, dtype=np.uint8).tobytes()],
                        "label": [part["label"].to_numpy(zero_copy_only=False).astype(np.int8).tobytes()],
                        "fold": [part["fold"].to_numpy(zero_copy_only=False).astype(np.int16).tobytes()],
                        "key": [part["key"].to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                    }
                )

    return rows.mapInArrow(pack, "n int, bins binary, label binary, fold binary, key binary")


def _unpacked(row, features: int) -> tuple[np.ndarray, ...]:
    """Bins, labels, folds and keys of a packed block."""
    label = np.frombuffer(row["label"], dtype=np.int8)
    return (
        np.frombuffer(row["bins"], dtype=np.uint8).reshape(features, row["n"]),
        2 * label - 1,
        np.frombuffer(row["fold"], dtype=np.int16),
        np.frombuffer(row["key"], dtype=np.uint64),
    )


@dataclass
class Trees:
    """The current tree of every model, nodes numbered as in a heap: feature
    (-1: a leaf), the last bin that goes left, the value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def stumps(cls, models: int, depth: int) -> "Trees":
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full((models, nodes), -1, np.int8), np.zeros((models, nodes), np.uint8), np.zeros((models, nodes)))

    def places(self, bins: np.ndarray, model: int, levels: int) -> np.ndarray:
        """Where every row stands after so many levels: its node's number from
        the left. The rows of a leaf go left from there on."""
        place = np.zeros(bins.shape[1], dtype=np.min_scalar_type(2**levels - 1))
        for level in range(levels):
            place = self.further(bins, model, level, place)
        return place

    def further(self, bins: np.ndarray, model: int, level: int, place: np.ndarray) -> np.ndarray:
        """Where rows stand one level below the given one."""
        nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
        feature, cut = self.feature[model, nodes], self.cut[model, nodes]
        inner = np.flatnonzero(feature >= 0)
        if len(inner) <= COMPARED_NODES:  # whole rows of bytes are compared faster than looked up
            right = np.zeros(len(place), dtype=bool)
            for node in inner.tolist():
                right |= (bins[feature[node]] > cut[node]) & (place == node)
        else:
            of = feature[place]
            right = (bins[np.maximum(of, 0), np.arange(len(place))] > cut[place]) & (of >= 0)
        return (place << 1) | right

    def set(self, model: int, level: int, splits: list[tuple]) -> None:
        """Enter the splits of a level's nodes, and the values below them."""
        for node, feature, cut, value, left, right in splits:
            at = 2**level - 1 + node
            self.feature[model, at], self.cut[model, at], self.value[model, at] = feature, cut, value
            if feature >= 0:
                self.value[model, 2 * at + 1], self.value[model, 2 * at + 2] = left, right

    def outputs(self, bins: np.ndarray, model: int, weight: float = 1.0) -> np.ndarray:
        """The weighted value of every row's leaf."""
        level, value = self.leaves(model)
        return (weight * value)[self.places(bins, model, level)]

    def leaves(self, model: int) -> tuple[int, np.ndarray]:
        """The levels that have a split, and the value of every place below them."""
        level, value = 0, self.value[model, :1]
        while (at := 2**level - 1) < self.feature.shape[1] // 2 and (inner := self.feature[model, at : 2 * at + 1] >= 0).any():
            below = self.value[model, 2 * at + 1 : 4 * at + 3].copy()
            below[::2] = np.where(inner, below[::2], value)
            level, value = level + 1, below
        return level, value


def _residuals(block: Block, model: int, tree: int, rows: np.ndarray) -> np.ndarray:
    y = block.label[rows]
    if tree == 0:
        return y
    return _residuals_at(y, block.scores[model, rows], block.unit)


def _residuals_at(y: np.ndarray, score: np.ndarray, unit: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        residual = 4 * y / (1 + np.exp(2 * y * score))
    if unit:  # numbers of this size have no smaller digits
        around = 1.5 * 2**52 * unit
        residual = (residual + around) - around
    return residual


def _columns(allowed: np.ndarray) -> np.ndarray:
    """The features that a level's histograms hold, nodes x columns: all, or
    those drawn for the node after the first feature, which tells its total."""
    if allowed.all():
        return np.broadcast_to(np.arange(allowed.shape[1]), allowed.shape)
    return np.insert(np.nonzero(allowed)[1].reshape(len(allowed), -1), 0, 0, axis=1)


def _histograms(block: Block, specs: list[Boosted], trees: Trees, tree: int, level: int, columns: dict[int, np.ndarray], n_bins: int) -> Iterator:
    """(model, [sum of residuals, rows] of each (node, column, bin) of the
    level); the columns of each model with a part in the level are given."""
    first, width, n = 2**level - 1, 2**level, len(block.label)
    flat = block.bins.ravel()
    draws: dict[int, np.ndarray] = {}  # models of one seed draw the same numbers
    for m, held in columns.items():
        spec = specs[m]
        take = np.ones(n, dtype=bool) if spec.held_out is None else block.fold != spec.held_out
        if spec.row_share < 1:
            if spec.seed not in draws:
                draws[spec.seed] = _draw(block.key, spec.seed, tree)
            take &= draws[spec.seed] < spec.row_share
        base = None
        if level:
            place = trees.places(block.bins, m, level)
            present = np.repeat(trees.feature[m, 2 ** (level - 1) - 1 : first] >= 0, 2)
            if not present.all():
                take &= present[place]
            rows = np.flatnonzero(take)
            place = place[rows]
            base = place * np.int64(n_bins)
        else:
            rows = np.flatnonzero(take)
        if not len(rows):
            continue
        residual = _residuals(block, m, tree, rows)
        out = np.empty((2, width, held.shape[1], n_bins))
        for j, features in enumerate(held.T):
            if (features == features[0]).all():
                slot = block.bins[features[0]][rows]
            else:
                slot = flat[(features * n)[place] + rows]
            if base is not None:
                slot = base + slot
            out[0, :, j] = np.bincount(slot, weights=residual, minlength=width * n_bins).reshape(width, n_bins)
            out[1, :, j] = np.bincount(slot, minlength=width * n_bins).reshape(width, n_bins)
        yield m, out


def best_splits(histogram: np.ndarray, min_rows: int, allowed: np.ndarray) -> list[tuple]:
    """For each node with rows: (node, feature or -1, cut, value, left value,
    right value), of its histogram and the features it may use."""
    sums, counts = histogram
    total, rows = sums[:, 0].sum(axis=1), counts[:, 0].sum(axis=1)
    left_sum, left = np.cumsum(sums, axis=2)[:, :, :-1], np.cumsum(counts, axis=2)[:, :, :-1]
    right_sum, right = total[:, None, None] - left_sum, rows[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        value, left_value, right_value = total / rows, left_sum / left, right_sum / right
        gain = left_value * left_sum + right_value * right_sum - (value * total)[:, None, None]
    fits = (left >= max(1, min_rows)) & (right >= max(1, min_rows)) & allowed[:, :, None]
    gain = np.where(fits, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(gain), dtype=np.int64)
    out = []
    for node in np.flatnonzero(rows).tolist():
        feature, cut = divmod(int(best[node]), max(1, gain.shape[2]))
        if flat.shape[1] and flat[node, best[node]] > ROUNDING * max(1.0, abs(value[node] * total[node])):
            out.append((node, feature, cut, value[node], left_value[node, feature, cut], right_value[node, feature, cut]))
        else:
            out.append((node, -1, 0, value[node], 0.0, 0.0))
    return out


def _allowed(spec: Boosted, tree: int, level: int, n_features: int) -> np.ndarray:
    """Which features each node of the level may use."""
    width, k = 2**level, spec.features or n_features
    if k >= n_features:
        return np.ones((width, n_features), dtype=bool)
    order = np.random.default_rng([spec.seed, tree, level]).random((width, n_features)).argsort(axis=1)
    return order < k


def _stepped(block: Block, specs: list[Boosted], trees: Trees, tree: int) -> Block:
    """The block after the given tree of every model that has one."""
    scores = block.scores.copy()
    for m, spec in enumerate(specs):
        if spec.trees > tree:
            scores[m] += trees.outputs(block.bins, m, 1.0 if tree == 0 else spec.step)
    return Block(block.bins, block.label, block.fold, block.key, scores, block.unit)


def _joint(sizes: Sequence[int]) -> list[list[int]]:
    """Features in groups: the bins of a group's features have at most
    ``JOINT_CELLS`` combinations (a feature of more is a group alone)."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for group in groups:
            if math.prod(sizes[g] for g in group) * sizes[f] <= JOINT_CELLS:
                group.append(f)
                break
        else:
            groups.append([f])
    return groups


class _Whole:
    """One model grown on the whole table, chunk by chunk."""

    def __init__(self, chunks: list[Chunk], spec: Boosted, sizes: Sequence[int], unit: float):
        self.chunks, self.spec, self.sizes, self.unit = chunks, spec, sizes, unit
        self.groups = _joint(sizes)
        self.cells = [math.prod(sizes[f] for f in group) for group in self.groups]
        self.trees = Trees.stumps(spec.trees, spec.depth)
        self.scores = [np.zeros(len(c.label)) for c in chunks]
        self.codes = [self._coded(c) for c in chunks]

    def _coded(self, chunk: Chunk) -> np.ndarray:
        """Every row's cell in each group (rows x groups); the held-out fold needs none."""
        if chunk.fold == self.spec.held_out:
            return np.zeros((0, len(self.groups)), dtype=np.uint16)
        codes = np.zeros((len(chunk.label), len(self.groups)), dtype=np.uint16)
        for code, group in zip(codes.T, self.groups):
            for f in group:
                code *= np.uint16(self.sizes[f])
                code += chunk.bins[f]
        return codes

    def grow(self) -> None:
        for tree in range(self.spec.trees):
            drawn = [self._drawn(i, tree) for i in range(len(self.chunks))]
            place = [np.zeros(len(c.label), np.min_scalar_type(2**self.spec.depth - 1)) for c in self.chunks]
            above = None
            for level in range(self.spec.depth):
                if level:
                    if not (self.trees.feature[tree, 2 ** (level - 1) - 1 : 2**level - 1] >= 0).any():
                        break
                    place = [self.trees.further(c.bins, tree, level - 1, p) for c, p in zip(self.chunks, place)]
                above = self._histogram(tree, level, drawn, place, above)
                allowed = _allowed(self.spec, tree, level, len(self.sizes))
                self.trees.set(tree, level, best_splits(above, self.spec.min_rows, allowed))
            levels, value = self.trees.leaves(tree)
            value = value if tree == 0 else self.spec.step * value
            for i, c in enumerate(self.chunks):
                if levels == self.spec.depth:
                    place[i] = self.trees.further(c.bins, tree, levels - 1, place[i])
                self.scores[i] += value.take(place[i])

    def _drawn(self, i: int, tree: int) -> tuple | None:
        """The rows of a chunk that the tree is fitted to: their numbers,
        residuals (each with a count of one as imaginary part) and cells."""
        chunk = self.chunks[i]
        if chunk.fold == self.spec.held_out:
            return None
        if self.spec.row_share < 1:
            rows = np.flatnonzero(_drawn(chunk.key, self.spec.seed, tree, self.spec.row_share))
        else:
            rows = np.arange(len(chunk.label))
        y = chunk.label.take(rows).astype(np.float64)
        residual = y if tree == 0 else _residuals_at(y, self.scores[i].take(rows), self.unit)
        counted = np.empty(len(rows), dtype=np.complex128)
        counted.real, counted.imag = residual, 1
        return rows, counted, self.codes[i].take(rows, axis=0)

    def _histogram(self, tree: int, level: int, drawn: list, place: list, above: np.ndarray | None) -> np.ndarray:
        """[sum of residuals, rows] of each (node, feature, bin) of the level,
        given those of the level above."""
        if not level:
            return self._counted(1, (d for d in drawn if d))  # no node numbers needed
        feature, cut = (a[tree, 2 ** (level - 1) - 1 : 2**level - 1] for a in (self.trees.feature, self.trees.cut))
        parents = np.flatnonzero(feature >= 0)
        reach = np.arange(above.shape[3]) <= cut[parents, None]
        rows = above[1, parents, feature[parents]]
        smaller = 2 * parents + ((rows * reach).sum(axis=1) * 2 > rows.sum(axis=1))
        number = np.full(2**level, -1, np.int16)
        number[smaller] = np.arange(len(parents))

        def parts() -> Iterator[tuple]:
            for d, p in zip(drawn, place):
                if d:
                    rows, residual, codes = d
                    node = number.take(p.take(rows))
                    at = np.flatnonzero(node >= 0)
                    yield node.take(at), residual.take(at), codes.take(at, axis=0)

        counted = self._counted(len(parents), parts())
        out = np.zeros((2, 2**level, *above.shape[2:]))
        out[:, smaller] = counted
        out[:, smaller ^ 1] = above[:, parents] - counted
        return out

    def _counted(self, nodes: int, parts: Iterator[tuple]) -> np.ndarray:
        """[sum of residuals, rows] of each (node, feature, bin) of rows in
        parts: their nodes, residuals and cells."""
        total = [np.zeros(nodes * cells, dtype=np.complex128) for cells in self.cells]
        for node, residual, codes in parts:
            for g, cells in enumerate(self.cells):
                slot = codes[:, g].astype(np.intp)
                if nodes > 1:
                    slot += node * np.intp(cells)
                np.add.at(total[g], slot, residual)  # a sum and a count at once
        out = np.zeros((2, nodes, len(self.sizes), max(self.sizes)))
        for g, group in enumerate(self.groups):
            joint = total[g].reshape(nodes, *(self.sizes[f] for f in group))
            for axis, f in enumerate(group, 1):
                single = joint.sum(axis=tuple(a for a in range(1, joint.ndim) if a != axis))
                out[0, :, f, : self.sizes[f]], out[1, :, f, : self.sizes[f]] = single.real, single.imag
        return out

    def held_out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Labels and scores of the rows of the held-out fold."""
        for c, score in zip(self.chunks, self.scores):
            if c.fold == self.spec.held_out:
                yield c.label, score


class _Plain:
    """One model grown on a small table, with the sums of ``_level``."""

    def __init__(self, table: list[list[Block]], spec: Boosted, sizes: Sequence[int], unit: float):
        self.table, self.spec, self.sizes = table, spec, sizes
        self.trees = Trees.stumps(spec.trees, spec.depth)

    def grow(self) -> None:
        spec = self.spec
        for tree in range(spec.trees):
            trees = Trees.stumps(1, spec.depth)
            for level in range(spec.depth):
                if level and not (trees.feature[0, 2 ** (level - 1) - 1 : 2**level - 1] >= 0).any():
                    break
                allowed = {0: _allowed(spec, tree, level, len(self.sizes))}
                total: dict[int, np.ndarray] = {}
                for part in self.table:
                    for m, h in _added_up(part, [spec], trees, tree, level, allowed, max(self.sizes)).items():
                        total[m] = total[m] + h if m in total else h
                for m, h in total.items():
                    trees.set(m, level, _picked(h, spec.min_rows, allowed[m]))
            self.table = [[_stepped(b, [spec], trees, tree) for b in part] for part in self.table]
            self.trees.feature[tree], self.trees.cut[tree], self.trees.value[tree] = trees.feature[0], trees.cut[0], trees.value[0]

    def held_out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Labels and scores of the rows of the held-out fold."""
        for block in (b for part in self.table for b in part):
            at = np.flatnonzero(block.fold == self.spec.held_out)
            if len(at):
                yield block.label[at], block.scores[0, at]


def _held_out(model: int, label: np.ndarray, score: np.ndarray) -> tuple:
    """A model, labels 0 / 1 and probabilities as bytes."""
    return model, (label > 0).astype(np.int32).tobytes(), (1 / (1 + np.exp(-2 * score))).tobytes()


@dataclass
class Grown:
    """The bins' cut points, every tree (as many as the longest model has),
    held-out rows in packed blocks, and how to drop what they are read from."""

    edges: list[np.ndarray]
    specs: list[Boosted]
    forest: list[Trees]
    held_out: RDD
    kept: Sequence[Callable[[], object]]

    def held_out_scores(self, spark) -> DataFrame:
        """(model, label 0 / 1, score): the probability that each model gives
        to every row of its held-out fold."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, label, score in zip(*(c.to_pylist() for c in batch.columns)):
                    labels = np.frombuffer(label, dtype=np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {"model": np.full(len(labels), m, np.int32), "label": labels, "score": np.frombuffer(score, dtype=np.float64)}
                    )

        packed = spark.createDataFrame(self.held_out, "model int, label binary, score binary")
        return packed.mapInArrow(unpack, "model int, label int, score double")

    def probabilities(self, values: np.ndarray, model: int) -> np.ndarray:
        """The probability a model gives to rows of feature values."""
        bins = np.array([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)], dtype=np.uint8)
        score = np.zeros(len(values))
        for t, trees in enumerate(self.forest[: self.specs[model].trees]):
            score += trees.outputs(bins, model, 1.0 if t == 0 else self.specs[model].step)
        return 1 / (1 + np.exp(-2 * score))

    def release(self) -> None:
        """Drop the persisted scores and the broadcast table."""
        for drop in self.kept:
            drop()


def grow_together(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    specs: Sequence[Boosted],
    fold: str | None = None,
    max_bins: int = 32,
) -> Grown:
    """All models of ``specs`` on ``df``: one job, or one job a level if the
    table is larger than a task should hold.

    ``label`` is 0 or 1, ``key`` tells rows apart for the row draws, ``fold``
    is compared with each model's ``held_out``. Rows without a label take no
    part. A null or NaN feature counts as larger than any value. Equal layouts
    give equal models, and so do equal rows of a table of more than
    ``PLAIN_ROWS``. An empty table, or a fold that leaves no rows, gives scores
    of 0 (a probability of one half).
    """
    specs = list(specs)
    sc = df.sparkSession.sparkContext
    ensure_checkpoint_dir(df.sparkSession)
    df = df.where(F.col(label).isNotNull())
    rows = df.count()
    edges = _edges(df, features, key, rows, max_bins)
    depth, unit = max(s.depth for s in specs), residual_unit(rows)
    packed = _packed(df, features, label, key, fold, edges)
    whole = len(specs) > 1 and rows <= WHOLE_ROWS and depth <= WHOLE_DEPTH
    if whole and unit:
        return _grow_whole(sc, _chunks(packed, len(edges)), specs, edges, unit)
    n_bins, n_features = max(len(e) for e in edges) + 1, len(edges)
    n_scores = 1 if whole else len(specs)

    def block(row) -> Block:
        bins, labels, folds, keys = _unpacked(row, n_features)
        return Block(bins, labels.astype(np.float64), folds, keys, np.zeros((n_scores, row["n"])), unit)

    # no more tasks a level than full blocks, nor than run at once unless they grow large; a single one needs no shuffle
    tasks = min(math.ceil(rows / BLOCK_ROWS), max(sc.defaultParallelism, math.ceil(rows / TASK_ROWS)))
    blocks = packed.rdd.map(block).coalesce(max(1, tasks))
    if whole:  # few rows
        return _grow_whole(sc, blocks.glom().collect(), specs, edges, unit)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    reducers = max(1, min(blocks.getNumPartitions(), len(specs), sc.defaultParallelism))
    forest: list[Trees] = []
    before, saved = None, None
    for tree in range(max(s.trees for s in specs)):
        if tree:
            before, blocks = blocks, _after(blocks, specs, forest[-1], tree - 1)
        trees = Trees.stumps(len(specs), depth)
        for level in range(depth):
            active = [m for m, s in enumerate(specs) if s.trees > tree and s.depth > level]
            if level:  # models whose last level had a split
                above = slice(2 ** (level - 1) - 1, 2**level - 1)
                active = [m for m in active if (trees.feature[m, above] >= 0).any()]
            if not active:
                break
            allowed = {m: _allowed(specs[m], tree, level, len(edges)) for m in active}
            for m, splits in _level(blocks, specs, trees, tree, level, allowed, n_bins, reducers):
                trees.set(m, level, splits)
            if before is not None:  # the new scores are persisted by now
                before.unpersist()
                before = None
        forest.append(trees)
        if blocks.isCheckpointed():
            _forget(sc, saved)
            saved = blocks.getCheckpointFile()
    final = _after(blocks, specs, forest[-1], len(forest) - 1)
    final.count()
    blocks.unpersist()

    def held_out(block: Block) -> Iterator[tuple]:
        for m, spec in enumerate(specs):
            at = np.flatnonzero(block.fold == spec.held_out)
            if len(at):
                yield _held_out(m, block.label[at], block.scores[m, at])

    return Grown(edges, specs, forest, final.flatMap(held_out), [final.unpersist])


def _chunks(packed: DataFrame, features: int) -> list[Chunk]:
    """The packed table, ordered by fold, in chunks of one fold each."""
    names = packed.columns
    rows = zip(*packed.toArrow().columns)
    blocks = [_unpacked({c: v.as_py() if c == "n" else v.as_buffer() for c, v in zip(names, row)}, features) for row in rows]
    folds = np.concatenate([fold for _, _, fold, _ in blocks]) if blocks else np.zeros(0, np.int16)
    out = []
    for fold in np.unique(folds).tolist():
        # of each array the fold's rows, block after block
        at = [np.flatnonzero(f == fold) for _, _, f, _ in blocks]
        bins, label, key = (np.concatenate([b[i].take(a, axis=-1) for b, a in zip(blocks, at)], axis=-1) for i in (0, 1, 3))
        for first in range(0, len(label), CHUNK_ROWS):
            rows = slice(first, first + CHUNK_ROWS)
            out.append(Chunk(np.ascontiguousarray(bins[:, rows]), label[rows].copy(), key[rows].copy(), fold))
    return out


def _grow_whole(sc, table: list, specs: list[Boosted], edges: list[np.ndarray], unit: float) -> Grown:
    """Every model in a task of its own, those with most work first. The table
    is chunks for exact sums, or, for plain ones, the blocks of every task that
    a level of a distributed table would have."""
    table = sc.broadcast(table)
    sizes = [len(e) + 1 for e in edges]

    def grown(m: int) -> Iterator[tuple]:
        model = (_Whole if unit else _Plain)(table.value, specs[m], sizes, unit)
        model.grow()
        yield m, model.trees
        for label, score in model.held_out():
            yield _held_out(m, label, score)

    work = [s.trees * (s.depth + 1) * s.row_share for s in specs]
    order = sorted(range(len(specs)), key=lambda m: -work[m])
    records = sc.parallelize(order, len(specs)).flatMap(grown).persist(StorageLevel.DISK_ONLY)
    forest = [Trees.stumps(len(specs), max(s.depth for s in specs)) for _ in range(max(s.trees for s in specs))]
    for m, trees in records.filter(lambda r: len(r) == 2).collect():  # a row per model: its trees
        for t, (feature, cut, value) in enumerate(zip(trees.feature, trees.cut, trees.value)):
            nodes = slice(0, len(value))
            forest[t].feature[m, nodes], forest[t].cut[m, nodes], forest[t].value[m, nodes] = feature, cut, value
    return Grown(edges, specs, forest, records.filter(lambda r: len(r) == 3), [records.unpersist, table.destroy])


def _after(blocks: RDD, specs: list[Boosted], trees: Trees, tree: int) -> RDD:
    """The blocks after a tree, to be persisted by the next job."""
    new = blocks.map(lambda b: _stepped(b, specs, trees, tree)).persist(StorageLevel.MEMORY_AND_DISK)
    if tree % CHECKPOINT_TREES == CHECKPOINT_TREES - 1:
        new.checkpoint()
    return new


def _forget(sc, checkpoint: str | None) -> None:
    """Delete a checkpoint that a later one has replaced."""
    if checkpoint:
        path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _added_up(part: Iterable[Block], specs, trees, tree, level, allowed, n_bins) -> dict[int, np.ndarray]:
    """The histogram of every model with a part in the level, of some blocks."""
    columns = {m: _columns(features) for m, features in allowed.items()}
    total: dict[int, np.ndarray] = {}
    for block in part:
        for m, h in _histograms(block, specs, trees, tree, level, columns, n_bins):
            total[m] = total[m] + h if m in total else h
    return total


def _picked(histogram: np.ndarray, min_rows: int, allowed: np.ndarray) -> list[tuple]:
    """The splits of a level's nodes, of the columns that were added up."""
    every = np.zeros((2, *allowed.shape, histogram.shape[3]))
    every[:, np.arange(len(allowed))[:, None], _columns(allowed)] = histogram
    return best_splits(every, min_rows, allowed)


def _level(blocks, specs, trees, tree, level, allowed, n_bins, reducers) -> list[tuple]:
    """(model, splits of the level's nodes) of every model with a part in it."""
    partial = blocks.mapPartitions(lambda part: iter(_added_up(part, specs, trees, tree, level, allowed, n_bins).items()))
    if blocks.getNumPartitions() > 1:
        partial = partial.reduceByKey(lambda a, b: a + b, reducers)
    # a row per model, a number of nodes in it
    return partial.map(lambda item: (item[0], _picked(item[1], specs[item[0]].min_rows, allowed[item[0]]))).collect()
