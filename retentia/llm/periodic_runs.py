"""Runs of repeated words in texts, found with suffix trees.

A run is a longest stretch of words of which every word equals the one a
period later. By the runs theorem every run holds its Lyndon root where the
next smaller, or the next larger, suffix of the text begins one period later.
So each position gives two candidates; a candidate is extended to the right by
the longest common extension of its two suffixes and to the left by that of
the reversed text. Both come from a suffix tree (Ukkonen's construction), in
constant time each: the lowest common ancestor of two leaves is the shallowest
turn of the Euler tour between them, which a sparse table gives.

Words of a run stand in word triples that occur again and again nearby. Before
trees are built, a document is cut down to the stretches whose triples do;
what is cut away can't hold a word of a run. The trees are those of all the
stretches of a document, each closed by a symbol of its own.

A document is one row and is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed

#: Bytes of text that are split into words at a time (one document at least).
CHUNK_BYTES = 1 << 20
#: Distinct words remembered between documents.
KNOWN_WORDS = 200_000

TRIPLE = 3


class WordNumbers(dict):
    """word (bytes) -> a number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def ukkonen(text: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """The suffix tree of ``text``, whose last symbol occurs once and whose
    symbols are below ``width``.

    Gives the edges (node * width + first symbol -> child; the root is 0), the
    string depth of every inner node and the suffix of every leaf, each by
    node number (-1 for nodes of the other kind).
    """
    n = len(text)
    edges: dict[int, int] = {}
    start, end, link, depth, suffix = [0], [0], [0], [0], [-1]
    nodes = 1
    node = at = length = waiting = 0  # the active point: below node, length symbols from text[at] on
    for i, symbol in enumerate(text):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                at = i
            key = node * width + text[at]
            child = edges.get(key)
            if child is None:
                edges[key] = nodes
                start.append(i)
                end.append(n)
                link.append(0)
                depth.append(-1)
                suffix.append(i - waiting + 1)
                nodes += 1
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                first = start[child]
                span = end[child] - first
                if length >= span:
                    at += span
                    length -= span
                    node = child
                    continue
                if text[first + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                inner, leaf = nodes, nodes + 1
                nodes += 2
                edges[key] = inner
                edges[inner * width + symbol] = leaf
                edges[inner * width + text[first + length]] = child
                start[child] = first + length
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                depth += (waiting - 1, -1)
                suffix += (-1, i - waiting + 1)
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return edges, depth, suffix


class CommonExtensions:
    """Longest common extensions of the suffixes of a text, in constant time."""

    def __init__(self, text: list[int], width: int):
        edges, depth, suffix = ukkonen(text, width)
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        child = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(-keys)  # children of a node side by side, the last one in order first
        above, child = keys[order] // width, child[order]
        n_nodes = len(depth)
        parent = np.zeros(n_nodes, dtype=np.int64)
        parent[child] = above
        below = np.bincount(above, minlength=n_nodes)
        stop = np.cumsum(below[::-1])[::-1]  # nodes lie in descending order
        first = (stop - below).tolist()
        last, kids = stop.tolist(), child.tolist()
        tour, stack = [], [0]
        while stack:
            node = stack.pop()
            tour.append(node)
            stack += kids[first[node] : last[node]]
        tour = np.array(tour)
        suffixes = np.array(suffix)[tour]
        leaves = np.flatnonzero(suffixes >= 0)
        self.order = suffixes[leaves]
        self.rank = np.empty(len(leaves), dtype=np.int64)
        self.rank[self.order] = np.arange(len(leaves))
        # after a leaf the tour turns at the parent of the next node
        turns = np.array(depth)[parent[tour[leaves[:-1] + 1]]].astype(np.int32)
        self.least = [turns]
        reach = 1
        while 2 * reach <= len(turns):
            before = self.least[-1]
            self.least.append(np.minimum(before[:-reach], before[reach:]))
            reach *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols from a on and from b on (a unlike b)."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for power in np.unique(level).tolist():
            at = np.flatnonzero(level == power)
            row = self.least[power]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << power)])
        return out


def _next_with(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The next place of a smaller and of a larger rank (the end if none is)."""
    n = len(ranks)
    smaller, larger = [n] * n, [n] * n
    falling, rising = [], []  # places that still wait for a larger, for a smaller rank
    for i, rank in enumerate(ranks):
        while rising and ranks[rising[-1]] > rank:
            smaller[rising.pop()] = i
        rising.append(i)
        while falling and ranks[falling[-1]] < rank:
            larger[falling.pop()] = i
        falling.append(i)
    return np.array(smaller), np.array(larger)


def runs_of(stretches: list[np.ndarray], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, length, period) of every run of the given sequences of
    numbers with length >= max(least, exponent * period), by stretch, start
    and period. ``exponent`` is 2 at least: shorter repeats are no runs."""
    sizes = np.array([len(s) for s in stretches])
    values, flat = np.unique(np.concatenate(stretches), return_inverse=True)
    n_stretches, n_words, n_values = len(stretches), len(flat), len(values)
    number = np.repeat(np.arange(n_stretches), sizes)
    place = np.arange(n_words) + number  # in the text, where a symbol of its own ends each stretch
    text = np.empty(n_words + n_stretches, dtype=np.int64)
    text[place] = flat
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = n_values + np.arange(n_stretches)
    width, n = n_values + n_stretches, len(text)
    forward = CommonExtensions(text.tolist(), width)
    backward = CommonExtensions([*text[-2::-1].tolist(), width - 1], width)

    smaller, larger = _next_with(forward.rank.tolist())
    left = np.concatenate([place, place])
    right = np.concatenate([smaller[place], larger[place]])
    home = np.concatenate([number, number])
    period = right - left
    fits = (right < ends[home]) & (np.maximum(least, exponent * period) <= sizes[home])
    left, right, home, period = left[fits], right[fits], home[fits], period[fits]
    after = forward.of(left, right)
    before = np.zeros(len(left), dtype=np.int64)
    inner = np.flatnonzero(left > 0)
    before[inner] = backward.of(n - 1 - left[inner], n - 1 - right[inner])
    length = before + period + after
    long = length >= np.maximum(least, exponent * period)
    start = (left - before - (ends - sizes)[home])[long]
    found = np.unique(np.stack([home[long], start, period[long], length[long]], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def live_stretches(words: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that may hold runs, of documents that lie
    one after another in ``words``, cut at ``bounds`` (0, ..., n).

    A run with period p has exponent * p words or more, so each of its triples
    occurs exponent - 1 times in it (for p = 1: its words less two). Triples
    that occur less often in their stretch cut it in two, until none does.
    Triples are counted by hashes; equal ones of unlike triples keep more.
    """
    least = max(least, exponent)
    often, streak = min(exponent - 1, least - 2), least - 2
    n = len(words)
    if n < TRIPLE or often < 2:
        whole = np.flatnonzero(np.diff(bounds) > 0)
        return bounds[whole], bounds[whole + 1]
    w = words.astype(np.uint64)
    triple = mixed(mixed(mixed(w[:-2]) ^ w[1:-1]) ^ w[2:])
    inside = np.ones(n - 2, dtype=bool)
    for back in (1, 2):
        cut = bounds[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n - 2)]] = False
    place = np.flatnonzero(inside)
    triple = triple[place]
    salt = 0
    while len(place):
        breaks = np.flatnonzero(np.diff(place) != 1) + 1
        sizes = np.diff(np.concatenate([[0], breaks, [len(place)]]))
        label = np.repeat(np.arange(len(sizes)), sizes)
        slots = 1 << max(8, (4 * len(place)).bit_length())
        slot = (mixed(triple ^ mixed(label.astype(np.uint64) + np.uint64(salt << 32))) & np.uint64(slots - 1)).astype(np.int64)
        keep = (np.bincount(slot, minlength=slots)[slot] >= often) & np.repeat(sizes >= streak, sizes)
        if keep.all():
            starts = np.concatenate([[0], breaks])
            return place[starts], place[starts] + sizes + 2
        place, triple, salt = place[keep], triple[keep], salt + 1
    return place, place


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def _searched(texts: list[bytes], known: WordNumbers, least: int, exponent: int) -> Iterator[tuple[list, np.ndarray, bytes]]:
    """(words, runs as rows of start, length, period, collapsed text) of each text."""
    split, numbers = [], []
    for text in texts:
        if len(known) > KNOWN_WORDS:
            known.clear()
        words = text.split()  # bytes: split at ASCII white space
        split.append(words)
        numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])])
    flat = np.concatenate(numbers)
    starts, ends = live_stretches(flat, bounds, least, exponent)
    first = np.searchsorted(starts, bounds).tolist()
    for i, words in enumerate(split):
        a, b = first[i], first[i + 1]
        if a == b:
            yield words, np.empty((0, 3), dtype=np.int64), b" ".join(words)
            continue
        home, start, length, period = runs_of([flat[s:e] for s, e in zip(starts[a:b], ends[a:b])], least, exponent)
        start = start + (starts[a:b] - bounds[i])[home]
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, start + length, -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()
        yield words, np.stack([start, length, period], axis=1), b" ".join([words[k] for k in kept])


RUNS_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then
    period; word numbers from 0), collapsed (the words that stay, joined by
    one space).

    Words are separated by ASCII white space. A run has a smallest period p,
    max(least, exponent * p) words or more, and can't be extended on either
    side; ``exponent`` is 2 at least. A word goes if any run contains it after
    that run's first p words. A null text has no words; a text without runs
    keeps all its words; null and repeated ids keep their rows; an empty table
    gives an empty result; other columns of ``docs`` are not looked at. The
    memory of a task grows with the longest text, not with the number of rows.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNumbers()
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(1).to_pylist()):
                words, runs, texts = zip(*_searched(chunk, known, least, exponent))
                table = np.concatenate(runs)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(run_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(chunk)),
                        pa.array([len(w) for w in words], type=pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), spans, type=run_type),
                        pa.array(texts, type=pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(chunk)

    return rows.mapInArrow(search, f"doc_id {id_type}, n_words bigint, runs {RUNS_TYPE}, collapsed string")
