"""Removal of repeated runs of lines by winnowing.

A text is cut into lines, and lines into sentences, so that passages inside a
line are found too; each piece is hashed. Of every WINDOW successive grams of
GRAM pieces the one with the least hash is a fingerprint, so any repeated run
of GRAM + WINDOW - 1 pieces or more holds one at the same place in both texts.
The words of the pieces are winnowed likewise, so any repeated run of
WORD_GRAM + WORD_WINDOW - 1 = 50 words holds a fingerprint, however long its
pieces are and wherever its ends lie in them.
Each later occurrence of a fingerprint is joined with its first occurrence
only, the match is extended both ways as far as the pieces (or words) agree, and the
later run is deleted. So a passage that a third of all texts share costs one
match per text, whatever its group's size.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import bundle, from_planes, gathered, planes, squeezed, unbundle, unsqueezed
from .shingles import mixed
from .store import BROADCAST_ROWS, TEXT_BATCH_ROWS, shuffle_width, written

GRAM, WINDOW = 2, 2
WORD_GRAM, WORD_WINDOW = 26, 25
_PIECE = re.compile(r"[^.!?\n]+[.!?]*")
#: Characters that are described at once, and fingerprints of a block for all buckets.
CHUNK_CHARS, BLOCK_PRINTS = 1 << 18, 1 << 20
_LISTS = "array<struct<start:int,end:int>>"
#: Kinds of characters; the last entry of _KIND stands for all above.
_BLANK, _INK, _STOP, _NEWLINE = range(4)
_KIND = np.array([_INK - chr(c).isspace() for c in range(0x3002)], dtype=np.uint8)
_KIND[[ord(c) for c in ".!?"]] = _STOP
_KIND[ord("\n")] = _NEWLINE
#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each piece that is not blank; white space inside
    a piece counts as one space."""
    found = [(m.start(), m.end(), m.group().split()) for m in _PIECE.finditer(text)]
    found = [x for x in found if x[2]]
    hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for _, _, w in found], dtype=np.uint64)
    return hashes, np.array([a for a, _, _ in found], dtype="<u4"), np.array([b for _, b, _ in found], dtype="<u4")


@functools.cache
def _char_hashes() -> np.ndarray:
    return mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(1024, 2 * n), base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.cumprod(known)
    return known[:n]


def _cut(text: str) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of each piece as ``pieces`` has them, then of each
    word of the pieces; a piece ends a word. ``text`` ends with a newline."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _KIND[np.minimum(chars, len(_KIND) - 1)]
    plain = kind < _STOP  # neither a stop nor a newline
    starts = np.flatnonzero(plain[1:] > plain[:-1]) + 1
    if plain[0]:
        starts = np.concatenate([[0], starts])
    lines = np.flatnonzero(kind == _NEWLINE)
    ends = np.minimum(lines[np.searchsorted(lines, starts)], np.append(starts[1:], len(chars)))
    ink = (kind == _INK) | (kind == _STOP)
    before = np.concatenate([[0], np.cumsum(ink, dtype=np.int32)])
    held = before[ends] > before[starts]
    starts, ends = starts[held], ends[held]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.view(np.uint64), none, none
    inside = np.zeros(len(chars) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    ink &= np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    opens[starts] |= ink[starts]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:] | opens[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    seen = chars[ink]
    sizes = last - first
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(seen)) - np.repeat(begins, sizes)
    values = _char_hashes()[seen] * _powers(_BASE, int(sizes.max()))[place]
    words = mixed(np.add.reduceat(values, begins) ^ sizes.astype(np.uint64))
    # the words of a piece with one space between them; the space before its first word is left out
    spaced = np.empty(len(seen) + len(first), dtype="<u4")
    head = begins + np.arange(len(first))
    spaced[head] = 32
    body = np.ones(len(spaced), dtype=bool)
    body[head] = False
    spaced[body] = seen
    data = spaced.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    bounds = np.append(head[np.searchsorted(first, starts)], len(spaced))
    if len(data) != len(spaced):
        widths = 1 + (spaced > 0x7F).astype(np.int64) + (spaced > 0x7FF) + (spaced > 0xFFFF)
        bounds = np.append(0, np.cumsum(widths))[bounds]
    bounds = bounds.tolist()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(data[a + 1 : b]) for a, b in zip(bounds, bounds[1:])), np.uint64, len(starts))  # noqa: B905
    return hashes, starts, ends, words, first, last


def _winnowed(grams: np.ndarray, begins: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram of each window, the last of equal ones, of
    texts whose grams are slices of ``grams``; fewer than a window are one."""
    chosen = np.zeros(len(grams), dtype=bool)
    least, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while width < window and width < len(grams):
        step = min(width, window - width)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    many = counts >= window
    chosen[at[gathered(begins[many], counts[many] - window + 1)]] = True
    for begin, n in zip(begins[~many].tolist(), counts[~many].tolist(), strict=True):
        if n > 0:
            chosen[begin + n - 1 - int(np.argmin(grams[begin : begin + n][::-1]))] = True
    return np.flatnonzero(chosen)


def _fingerprints(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the fingerprints of pieces, of texts one after another."""
    grams = np.full(max(0, len(hashes) - GRAM + 1), GRAM, dtype=np.uint64)
    for i in range(GRAM):
        grams = mixed(grams ^ hashes[i : i + len(grams)])
    chosen = _winnowed(grams, begins, sizes - GRAM + 1, WINDOW)
    return chosen, grams[chosen]


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the least gram of each window, the last of
    equal ones; of all grams if there are fewer than a window."""
    return _fingerprints(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))


def _word_fingerprints(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of grams of WORD_GRAM words, as differences of running sums."""
    n = max(0, len(hashes) - WORD_GRAM + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)))])
    grams = mixed((sums[WORD_GRAM:] - sums[:n]) * _powers(_INVERSE, n))
    chosen = _winnowed(grams, begins, sizes - WORD_GRAM + 1, WORD_WINDOW)
    return chosen, grams[chosen]


def _steps(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Steps between successive starts and ends, of each text from its edge on."""
    steps = np.diff(np.stack([starts, ends], axis=1).ravel(), prepend=0)
    held = cuts[1:] > cuts[:-1]
    begins = cuts[:-1][held]
    steps[2 * begins] = starts[begins] - edges[:-1][held]
    return steps


def _layout(n_pieces: int, data: bytes) -> tuple[np.ndarray, ...]:
    """Starts and ends of pieces, then of words."""
    raw = unsqueezed(data)
    steps = np.frombuffer(raw, "<u4" if raw[0] else np.uint8, offset=4)
    bounds = [np.cumsum(x, dtype=np.int64) for x in (steps[: 2 * n_pieces], steps[2 * n_pieces :])]
    return bounds[0][::2], bounds[0][1::2], bounds[1][::2], bounds[1][1::2]


def _dealt(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each bucket that has any, in their order."""
    buckets = buckets.astype(np.uint16 if n <= 1 << 16 else np.int64)
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, order[edges[bucket] : edges[bucket + 1]]


def _steps_of(values: np.ndarray) -> bytes:
    """Integers that rise slowly, compressed."""
    return squeezed(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueezed(data), np.int64))


def _prints(found: list[tuple[np.ndarray, ...]], n: int) -> pa.RecordBatch:
    """Fingerprints (gram, text's row, no id, id, place) as a block per bucket of the gram."""
    gram, row, no_id, doc_id, place = (np.concatenate(x) for x in zip(*found, strict=True))
    out = []
    # by the lower bits: as minima, fingerprints have small upper ones
    for bucket, at in _dealt((gram & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32), n):
        block = bundle(_steps_of(row[at]), squeezed(no_id[at].tobytes(), 1), _steps_of(doc_id[at]), planes(place[at]))
        out.append((bucket, gram[at].tobytes(), block))
    return _rows(_TABLE, {"bucket": [x[0] for x in out], "grams": [x[1] for x in out], "block": [x[2] for x in out]})


_TABLE = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.binary()) for c in ("hashes", "words", "layout")]
    + [("bucket", pa.int32()), ("grams", pa.binary()), ("block", pa.binary())]
)


def _rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """Rows of these columns; the others of the schema are null."""
    n = len(next(iter(columns.values())))
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in columns.items()}
    made = [given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of CHUNK_CHARS characters together, or of one text."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > CHUNK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if texts:
        yield start, len(texts)


def _described(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per text, and blocks of fingerprints for ``n`` buckets. Places
    are twice the number of a piece, or of a word and one more."""
    found, size = [], 0
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        rows, ids = batch.column(0).to_numpy(), batch.column(1)
        no_id, ids_or_0 = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        texts = batch.column(2).to_pylist()
        made = {"hashes": [], "words": [], "layout": []}
        for a, b in _chunks(texts):
            edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
            hashes, starts, ends, words, first, last = _cut("\n".join(texts[a:b]) + "\n")
            cuts, word_cuts = np.searchsorted(starts, edges), np.searchsorted(first, edges)
            prints = []
            for kind, (made_of, x, to) in enumerate(((_fingerprints, hashes, cuts), (_word_fingerprints, words, word_cuts))):
                at, gram = made_of(x, to[:-1], np.diff(to))
                text = np.searchsorted(to, at, "right") - 1
                prints.append((gram, text + a, 2 * (at - to[text]) + kind))
            gram, text, place = (np.concatenate(x) for x in zip(*prints, strict=True))
            by_text = np.argsort(text, kind="stable")
            gram, text, place = gram[by_text], text[by_text], place[by_text]
            found.append((gram, rows[text], no_id[text], ids_or_0[text], place))
            size += len(gram)
            # half of a hash: what lies beyond a match is compared word by word
            half = (words >> np.uint64(32)).astype("<u4")
            steps = _steps(starts, ends, cuts, edges), _steps(first, last, word_cuts, edges)
            wide = [set((np.searchsorted(c, np.flatnonzero(x > 0xFF) // 2, "right") - 1).tolist()) for c, x in zip((cuts, word_cuts), steps, strict=True)]
            small = [x.astype(np.uint8) for x in steps]
            cuts, word_cuts = cuts.tolist(), word_cuts.tolist()
            for i in range(b - a):
                p, q, w, x = cuts[i], cuts[i + 1], word_cuts[i], word_cuts[i + 1]
                is_wide = i in wide[0] or i in wide[1]
                parts = [y[2 * c : 2 * d] for y, c, d in zip(steps if is_wide else small, (p, w), (q, x), strict=True)]
                parts = [y.astype("<u4") for y in parts] if is_wide else parts
                made["hashes"].append(hashes[p:q].tobytes())
                made["words"].append(half[w:x].tobytes())
                made["layout"].append(compress(bytes([is_wide, 0, 0, 0]) + parts[0].tobytes() + parts[1].tobytes()))
            if size >= BLOCK_PRINTS:
                yield _prints(found, n)
                found, size = [], 0
        yield _rows(_TABLE, {"row": batch.column(0), "doc_id": ids, **made})
    if size:
        yield _prints(found, n)


def _matches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Each later occurrence of a fingerprint with its first one, as a block
    per bucket of the later text's row; all blocks of a gram are here."""
    blocks = [(g.as_py(), unbundle(b.as_py())) for batch in batches for g, b in zip(batch.column(1), batch.column(2), strict=True)]
    if not blocks:
        return
    gram = np.concatenate([np.frombuffer(g, np.uint64) for g, _ in blocks])
    row = np.concatenate([_from_steps(b[0]) for _, b in blocks])
    no_id = np.concatenate([np.frombuffer(unsqueezed(b[1]), bool) for _, b in blocks])
    doc_id = np.concatenate([_from_steps(b[2]) for _, b in blocks])
    place = np.concatenate([from_planes(b[3]) for _, b in blocks])
    del blocks
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    several = order[np.append(same, False) | np.append(False, same)]
    several = several[np.lexsort([x[several] for x in (place, row, doc_id, no_id, gram)])]
    heads = np.append(True, gram[several[1:]] != gram[several[:-1]])[: len(several)]
    first = several[np.maximum.accumulate(np.where(heads, np.arange(len(several)), 0))][~heads]
    later = several[~heads]
    by_text = np.lexsort((row[first], row[later]))
    first, later = first[by_text], later[by_text]
    out = []
    for bucket, at in _dealt(mixed(row[later].astype(np.uint64)) % np.uint64(n), n):
        x, y = later[at], first[at]
        out.append((bucket, bundle(_steps_of(row[x]), _steps_of(row[y]), planes(place[x]), planes(place[y]))))
    yield _rows(_BLOCKS, {"bucket": [x[0] for x in out], "block": [x[1] for x in out]})


_BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
_PAIRS = pa.schema([("row", pa.int64()), ("first_row", pa.int64()), ("matches", pa.binary()), ("by_words", pa.bool_())])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for two texts, with all places they share: no more than the
    later one has fingerprints. All blocks of a later text are here."""
    blocks = [unbundle(b.as_py()) for batch in batches for b in batch.column(1)]
    if not blocks:
        return
    row, first_row = (np.concatenate([_from_steps(b[i]) for b in blocks]) for i in (0, 1))
    at, origin = (np.concatenate([from_planes(b[i]) for b in blocks]) for i in (2, 3))
    order = np.lexsort((origin, at, first_row, row))
    row, first_row, at, origin = (x[order] for x in (row, first_row, at, origin))
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first_row[1:] != first_row[:-1])))
    by_words = np.logical_or.reduceat(at % 2 == 1, heads)
    edges = [*heads.tolist(), len(row)]
    both = np.stack([at, origin], axis=1)
    matches = [squeezed(np.diff(both[a:b].view(np.int32), axis=0, prepend=np.int32(0)).tobytes(), 1) for a, b in zip(edges, edges[1:])]  # noqa: B905
    for a in range(0, len(heads), TEXT_BATCH_ROWS):
        part = slice(a, a + TEXT_BATCH_ROWS)
        yield _rows(_PAIRS, {"row": row[heads[part]], "first_row": first_row[heads[part]], "matches": matches[part], "by_words": by_words[part]})


def _agreed(later: np.ndarray, first: np.ndarray, at: np.ndarray, origin: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How far ``later`` agrees with ``first`` from each place and its origin
    on, in steps of 1 or -1, up to the room there is."""
    agreed = np.zeros(len(at), dtype=np.int64)
    live, width = np.flatnonzero(room > 0), 8
    while len(live):
        ahead = np.arange(width)
        far = step * (agreed[live, None] + ahead)
        same = later.take(at[live, None] + far, mode="clip") == first.take(origin[live, None] + far, mode="clip")
        same &= ahead < (room - agreed)[live, None]
        gone = np.where(same.all(axis=1), width, same.argmin(axis=1))
        agreed[live] += gone
        live = live[gone == width]
        width = min(2 * width, max(8, CHUNK_CHARS // max(1, len(live))))
    return agreed


def _runs(pair: np.ndarray, at: np.ndarray, origin: np.ndarray, laters: list[bytes], firsts: list[bytes], kind: np.dtype) -> list[bytes]:
    """Per pair of texts the runs (start, end) around its matches that agree.
    Of the matches of a diagonal only those that no run holds are extended."""
    (later, size, begin), (first, first_size, first_begin) = (
        (np.frombuffer(b"".join(x), kind), n := np.array([len(y) // kind.itemsize for y in x], np.int64), np.cumsum(n) - n) for x in (laters, firsts)
    )
    order = np.lexsort((at, at - origin, pair))
    pair, at, origin = pair[order], at[order], origin[order]
    heads = np.append(True, (pair[1:] != pair[:-1]) | (np.diff(at) != np.diff(origin)))[: len(pair)]
    span = int(size.max(initial=0)) + 1
    keys = (np.cumsum(heads) - 1) * span + at
    live = np.flatnonzero(heads)
    ends, group = np.append(live[1:], len(pair)), np.arange(len(live))
    found = [np.zeros((0, 3), np.int64)]
    while len(live):
        p, x, y = pair[live], at[live], origin[live]
        a, b = begin[p] + x, first_begin[p] + y
        end = x + _agreed(later, first, a, b, np.minimum(size[p] - x, first_size[p] - y), 1)
        start = x - _agreed(later, first, a - 1, b - 1, np.minimum(x, y), -1)
        found.append(np.stack([p, start, end], axis=1))
        following = np.maximum(live + 1, np.searchsorted(keys, group * span + end))
        more = following < ends[group]
        live, group = following[more], group[more]
    runs = np.concatenate(found)
    runs = runs[np.lexsort(runs.T[::-1])]
    runs = runs[np.append(True, (runs[1:] != runs[:-1]).any(axis=1))[: len(runs)]]
    cuts = np.searchsorted(runs[:, 0], np.arange(len(laters) + 1)).tolist()
    bounds = runs[:, 1:].astype("<u4")
    return [bounds[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (start, end) of pieces and of words of one text that a second one
    holds first, from all their matches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        both = [np.frombuffer(unsqueezed(m.as_py()), np.int32).reshape(-1, 2).cumsum(axis=0, dtype=np.int64) for m in batch.column(1)]
        pair = np.repeat(np.arange(len(both)), [len(x) for x in both])
        at, origin = np.concatenate(both).T
        later, first, later_words, first_words = (c.to_pylist() for c in batch.columns[2:])
        later_words = [(first_words if x is None else later_words)[i] or b"" for i, x in enumerate(later)]
        later = [y if x is None else x for x, y in zip(later, first, strict=True)]
        arrays = [later, first, later_words, [x or b"" for x in first_words]]
        out = []
        for kind, width in enumerate((np.dtype(np.uint64), np.dtype("<u4"))):
            mine = at % 2 == kind
            out.append(_runs(pair[mine], at[mine] // 2, origin[mine] // 2, *arrays[2 * kind : 2 * kind + 2], width))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.binary()) for x in out)], names=["row", "runs", "word_runs"]
        )


def _marked(runs: list[bytes], n: int) -> np.ndarray:
    """What lies in a run."""
    bounds = np.frombuffer(b"".join(runs), "<u4")
    return np.cumsum(np.bincount(bounds[::2], minlength=n + 1) - np.bincount(bounds[1::2], minlength=n + 1))[:n] > 0


def _spans(dead: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], dead, [False]])))
    return list(zip(starts[edge[::2]].tolist(), ends[edge[1::2] - 1].tolist(), strict=True))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deleted pieces and words of a document as character spans, from its runs."""
    for batch in batches:
        lines, gone, starts, ends, offsets = [], [], [], [], [0]
        ids, *rest = batch.columns
        for n, layout, own, own_words in zip(*(c.to_pylist() for c in rest), strict=True):
            a, b, first, last = _layout(n, layout)
            dead = _marked(own, n)
            found = []
            if any(own_words):
                dead_words = _marked(own_words, len(first))
                alive = np.concatenate([[0], np.cumsum(~dead_words)])
                dead |= alive[np.searchsorted(first, a)] == alive[np.searchsorted(first, b)]
                found = _spans(dead_words, first, last)
            for start, end in sorted(_spans(dead, a, b) + found):
                if len(ends) > offsets[-1] and start <= ends[-1]:
                    ends[-1] = max(end, ends[-1])
                else:
                    starts.append(start)
                    ends.append(end)
            offsets.append(len(ends))
            lines.append(n)
            gone.append(int(dead.sum()))
        spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (starts, ends)], names=["start", "end"])
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
            names=["doc_id", "n_lines", "n_deleted", "spans"],
        )


def _flagged(table: DataFrame, rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``table`` with a flag for each condition: true where ``rows`` has a row
    of the same number that fulfils it. The flags travel as sets of 64 bits;
    if even those are too many to broadcast, every flag is true."""
    bit, word = F.expr("shiftleft(1L, cast(row & 63 as int))"), F.shiftright("row", 6).alias("_word")
    sets = written(rows.groupBy(word).agg(*(F.bit_or(F.when(c, bit).otherwise(F.lit(0))).alias(f"_set_{k}") for k, c in flags.items())), "flags")
    if sets.count() > BROADCAST_ROWS:
        return table.withColumns({k: F.lit(True) for k in flags})
    both = table.withColumn("_word", word).join(F.broadcast(sets), "_word", "left")
    held = {k: F.coalesce(F.expr(f"getbit(_set_{k}, cast(row & 63 as int))") == 1, F.lit(False)) for k in flags}
    return both.withColumns(held).drop("_word", *(f"_set_{k}" for k in flags))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines (pieces), n_deleted (whole pieces), spans
    (character spans to delete, in order; of pieces or of words).

    Texts come in the order of their ids, null ids last, then of their rows;
    the first occurrence of a run stays, later ones go, also within one text.
    Every repeated run of GRAM + WINDOW - 1 pieces, or of 50 words, has a
    match; shorter ones may have. A fingerprint is followed to its first
    occurrence, so where a run is made up of parts that occur first in
    different texts, a piece or two between the parts, or fewer than
    WORD_WINDOW words at either end of the whole run, may stay. A null or empty text has no pieces; repeated rows are repeated
    texts; an empty table gives an empty result; other columns are not looked at.
    """
    n = shuffle_width(docs.sparkSession)
    table = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).mapInArrow(
            functools.partial(_described, n=n),
            "row long, doc_id long, hashes binary, words binary, layout binary, bucket int, grams binary, block binary",
        ),
        "pieces",
    )
    texts = table.where("bucket is null")
    later = (
        table.where("bucket is not null")
        .select("bucket", "grams", "block")
        .repartitionByRange(n, "bucket")  # by hash, several of the buckets would often meet in a task
        .mapInArrow(functools.partial(_matches, n=n), "bucket int, block binary")
    )
    matches = written(
        later.repartition(n, "bucket").mapInArrow(_paired, "row long, first_row long, matches binary, by_words boolean"), "matches"
    )
    # only texts of a match travel, and their words only where a match is of words
    flags = {"matched": F.lit(True), "words_matched": F.col("by_words")}
    arrays = lambda rows: _flagged(texts.select("row", "hashes", "words"), rows, flags).where("matched").select("row", "hashes", F.when(F.col("words_matched"), F.col("words")).alias("words"))
    own = arrays(matches).withColumnsRenamed({"hashes": "later", "words": "later_words"})
    firsts_of = matches.select(F.col("first_row").alias("row"), "by_words")
    other = arrays(firsts_of).withColumnsRenamed({"row": "first_row", "hashes": "first", "words": "first_words"})
    extended_runs = (
        matches.join(own, "row")
        # within one text the first one's arrays are the later one's too
        .withColumn("later", F.when(F.col("row") != F.col("first_row"), F.col("later")))
        .withColumn("later_words", F.when(F.col("by_words") & (F.col("row") != F.col("first_row")), F.col("later_words")))
        .join(other, "first_row")
        .select("row", "matches", "later", "first", "later_words", F.when(F.col("by_words"), F.col("first_words")).alias("first_words"))
        .mapInArrow(_extend, "row long, runs binary, word_runs binary")
    )
    found = written(extended_runs, "runs")
    runs = found.groupBy("row").agg(*(F.collect_list(k).alias(k) for k in ("runs", "word_runs")))
    n_lines = F.expr("octet_length(hashes) div 8").alias("n_lines")
    flagged = _flagged(texts.select("row", "doc_id", n_lines, "layout"), found, {"repeats": F.lit(True)})
    none = flagged.where("not repeats").select(
        "doc_id", "n_lines", F.lit(0).cast("long").alias("n_deleted"), F.array().cast(_LISTS).alias("spans")
    )
    return (
        flagged.where("repeats")
        .join(runs, "row", "left")
        .withColumns({k: F.coalesce(k, F.array().cast("array<binary>")) for k in ("runs", "word_runs")})
        .select("doc_id", "n_lines", "layout", "runs", "word_runs")
        .mapInArrow(_united, f"doc_id long, n_lines long, n_deleted long, spans {_LISTS}")
        .unionByName(none)
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some of its spans."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]
