"""Byte-level BPE by a global shuffle of distinct words.

Documents are split into pre-tokens. A block of documents sends each of its
distinct pre-tokens once, with the positions it has in the block, to the
bucket of that word; there every distinct word is encoded once, and its ids
go back with the positions to the block, which puts them in order. So a word
that all documents hold is one row per block, and no row grows with the
corpus. Rows carry a bucket's share of a block as packed arrays.

Decoding joins each id with its bytes in the token table, whose size is the
vocabulary's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .packed import bundle, from_integers, from_planes, gathered, integers, planes, squeezed, unbundle, unsqueezed
from .store import shuffle_width

#: A block is closed when its texts pass this many characters.
BLOCK_CHARS = 10_000_000
#: Compression of words and ids, of which the shuffles are made up besides positions.
_LEVEL = 12

_WORDS, _DOCS = 0, 1
_ROWS = "kind int, bucket int, block long, payload binary"


def _rows(kind: list[int], bucket: list[int], block: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())],
        names=["kind", "bucket", "block", "payload"],
    )


class _Block:
    """Pre-tokens of some documents, numbered by first use."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.sequences: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str, split) -> None:
        numbers = self.numbers
        self.sequences.append(np.array([numbers.setdefault(w, len(numbers)) for w in split(text)], dtype=np.uint32))
        self.ids.append(doc_id)
        self.chars += len(text) + 64

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        counts = np.array([len(s) for s in self.sequences], dtype=np.uint32)
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8").tobytes()
        known = np.array([i is not None for i in self.ids], dtype=np.uint8).tobytes()
        yield _rows([_DOCS], [block % buckets], [block], [bundle(squeezed(ids), squeezed(known), planes(counts))])
        words = [w.encode() for w in self.numbers]
        if not words:
            return
        of = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)
        order = np.argsort(of, kind="stable")  # within a bucket by first use
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        tokens = rank[np.concatenate(self.sequences)]
        places = np.argsort(tokens, kind="stable")
        uses = np.bincount(tokens, minlength=len(words))
        first = np.cumsum(uses) - uses
        steps = np.diff(places, prepend=0)
        later = np.ones(len(places), dtype=bool)
        later[first] = False
        words = [words[i] for i in order]
        sizes = np.array([len(w) for w in words], dtype=np.uint32)
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for bucket in range(buckets):
            a, b = int(bounds[bucket]), int(bounds[bucket + 1])
            if a == b:
                continue
            span = slice(int(first[a]), int(first[b - 1] + uses[b - 1]))
            payload = bundle(
                planes(sizes[a:b]),
                squeezed(b"".join(words[a:b]), _LEVEL),
                planes(uses[a:b]),
                planes(np.diff(places[first[a:b]], prepend=0)),  # first positions grow
                planes(steps[span][later[span]]),  # of each word, distances to its later ones
            )
            yield _rows([_WORDS], [bucket], [block], [payload])


def _positions(uses: np.ndarray, firsts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each word's positions in the block, word by word."""
    at = np.cumsum(uses) - uses
    moves = np.zeros(int(uses.sum()), dtype=np.int64)
    later = np.ones(len(moves), dtype=bool)
    later[at] = False
    moves[later] = steps
    run = np.cumsum(moves)
    return run + np.repeat(np.cumsum(firsts) - run[at], uses)


def _blocks(buckets: int, block_chars: int):
    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(vocabulary.pattern()).findall
        base = TaskContext.get().partitionId() << 32
        at, block = 0, _Block()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1), strict=True):
                block.add(i, text.as_py() or "", split)
                if block.chars > block_chars:
                    yield from block.rows(base + at, buckets)
                    at, block = at + 1, _Block()
        if block.ids:
            yield from block.rows(base + at, buckets)

    return split_up


def _encode_words(vocab: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoding(vocab).encode_ordinary
        known: dict[bytes, list[int]] = {}  # the words of this task's buckets
        for batch in batches:
            kinds, buckets, blocks, payloads = (c.to_pylist() for c in batch.columns)
            for kind, bucket, block, payload in zip(kinds, buckets, blocks, payloads, strict=True):
                if kind == _WORDS:
                    sizes, blob, *where = unbundle(payload)
                    ends = np.cumsum(from_planes(sizes), dtype=np.int64).tolist()
                    blob, start, ids = unsqueezed(blob), 0, []
                    for end in ends:
                        word = blob[start:end]
                        found = known.get(word)
                        if found is None:
                            found = known[word] = encoder(word.decode())
                        ids.append(found)
                        start = end
                    lengths = np.array([len(x) for x in ids], dtype=np.uint32)
                    flat = np.array([x for y in ids for x in y], dtype=np.uint32)
                    payload = bundle(planes(lengths), integers(flat, _LEVEL), *where)
                yield _rows([kind], [bucket], [block], [payload])

    return encode


def _bytes_of(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _ids_of_block(group: pa.Table) -> pa.Table:
    """doc_id, n_tokens, ids of the documents of a block."""
    kinds, payloads = group["kind"].to_pylist(), group["payload"].to_pylist()
    docs = [unbundle(p) for k, p in zip(kinds, payloads, strict=True) if k == _DOCS]
    parts = [unbundle(p) for k, p in zip(kinds, payloads, strict=True) if k == _WORDS]
    if len(docs) != 1:
        raise RuntimeError(f"a block has {len(docs)} document rows")
    ids = np.frombuffer(unsqueezed(docs[0][0]), dtype="<i8")
    known = np.frombuffer(unsqueezed(docs[0][1]), dtype=np.uint8)
    counts = from_planes(docs[0][2]).astype(np.int64)
    total = int(counts.sum())
    length, start = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
    word_ids, before = [], 0
    for lengths, flat, *where in parts:
        lengths, flat = from_planes(lengths).astype(np.int64), from_integers(flat)
        uses, firsts, steps = (from_planes(x).astype(np.int64) for x in where)
        places = _positions(uses, firsts, steps)
        length[places] = np.repeat(lengths, uses)
        start[places] = np.repeat(before + np.cumsum(lengths) - lengths, uses)
        word_ids.append(flat)
        before += len(flat)
    table = np.concatenate(word_ids).astype("<u4") if word_ids else np.zeros(0, dtype="<u4")
    ends = np.cumsum(counts)
    id_ends = np.concatenate([[0], np.cumsum(length)])
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        out.append(table[gathered(start[a:b], length[a:b])].tobytes())
    sizes = [int(id_ends[b] - id_ends[a]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=known == 0),
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids": pa.array(out, pa.binary()),
        }
    )


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = vocabulary.RANK_FILE,
    block_chars: int = BLOCK_CHARS,
    with_decoded: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) per row;
    ``with_decoded`` adds what ``decode`` makes of the ids, without handing
    them to another Python worker.

    Every match of the vocabulary's pattern is encoded by itself, without
    special tokens. A null or empty text has no ids; a null id stays null and
    repeated rows stay repeated; an empty table gives an empty result; other
    columns are not looked at. A text of any length is one row of one block.
    ``docs`` should give the same rows in the same order when a lost task is
    repeated, as a stored table does.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    words = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _blocks(width, block_chars), _ROWS
    )
    coded = words.repartitionById(width, F.col("bucket")).mapInArrow(_encode_words(vocab), _ROWS)

    def reassemble(group: pa.Table) -> pa.Table:
        done = _ids_of_block(group)
        if with_decoded:
            table = vocabulary.token_bytes(vocab)
            decoded = [_bytes_of(x.as_py(), table) for x in done["ids"]]
            done = done.append_column("decoded", pa.array(decoded, pa.binary()))
        return done

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * with_decoded
    return coded.groupBy("block").applyInArrow(reassemble, schema)


def decode(encoded: DataFrame, vocab: str = vocabulary.RANK_FILE) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``, the bytes that the
    ids stand for; an id outside the vocabulary is an error, null ids count
    as none."""

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.token_bytes(vocab)
        for batch in batches:
            out = [_bytes_of(x.as_py() or b"", table) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    names = ["doc_id", "n_tokens", "ids"]
    return encoded.select(*names).mapInArrow(join_bytes, "doc_id long, n_tokens long, ids binary, decoded binary")
