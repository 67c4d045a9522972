"""Katz backoff scores of the documents of a corpus by its own training part.

Orders: bigrams, then words, then the class of unknown words. Counts below
LARGEST are discounted by Good-Turing; what that frees is given to the words
not seen after a context, in proportion to their probability without it:

    P(w | v) = d(c(v, w)) c(v, w) / c(v)     if v, w occur together
             = a(v) P(w)                     otherwise
    P(w)     = d(c(w)) c(w) / N              if w occurs
             = what is left of 1             for all unknown words together

a(v) is such that P(. | v) adds up to 1 exactly. Counts from LARGEST on keep
all but KEPT_BACK of their mass, so that nothing has probability 0.

Tables: word counts are a stored table. Token occurrences are dealt by the
hash of the word (of the pair, for words so frequent that one partition would
hold too many) into partitions, each of which has all bigrams of its words:
it counts them, looks up every token of every document, and sends on what
depends on the context alone: parts of the sums that a(v) is made of, and
tokens not seen after their context. These are dealt by the context, where
a(v) is computed and the remaining tokens get theirs. Sums over a document's
tokens come back by document. Partitions hold packed arrays, a row for each
block of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import bundle, from_integers, from_planes, integers, planes, squeezed, unbundle, unsqueezed
from .shingles import WordHashes, mixed, word_hashes
from .store import shuffle_width, written

#: Counts up to LARGEST are told apart; those below it are discounted.
LARGEST, KEPT_BACK = 6, 1e-6
#: Texts of a block of documents, in bytes.
BLOCK_BYTES = 10_000_000
#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(1), np.uint64(2)

_ENTRIES, _DOCS, _SCORED, _CONTEXTS, _UNSEEN = range(5)


# --- discounts --------------------------------------------------------------------


def discounts(count_of_counts: dict[int, int]) -> np.ndarray:
    """d(0..LARGEST + 1): the share that a count keeps; the last one holds for
    all larger counts. Where Good-Turing gives no share between 0 and 1 (too
    few counts of counts), half a count is taken off instead."""
    n = [count_of_counts.get(r, 0) for r in range(LARGEST + 1)]
    common = LARGEST * n[LARGEST] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, LARGEST):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array([*out, 1 - KEPT_BACK, 1 - KEPT_BACK])


def capped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, LARGEST + 1).astype(np.int64)


class Words:
    """What holds for all words: token and word numbers, discounts, the mass of unknown words."""

    def __init__(self, counts: dict[int, int], tokens: int, words: int):
        self.tokens, self.words, self.discount = tokens, words, discounts(counts)
        small = sum(self.discount[r] * r * counts.get(r, 0) for r in range(1, LARGEST + 1))
        large = tokens - sum(r * counts.get(r, 0) for r in range(1, LARGEST + 1))
        self.unknown = 1 - (small + self.discount[-1] * large) / tokens if tokens else 1.0

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        known = np.maximum(counts, 1) * self.discount[capped(np.maximum(counts, 1))] / max(1, self.tokens)
        return np.log10(np.where(counts > 0, known, self.unknown))


# --- blocks of documents -------------------------------------------------------------


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(data), dtype="<u8")


def _hash_bytes(values: np.ndarray) -> bytes:
    return squeezed(values.astype("<u8").tobytes())


def _block_rows(docs: list[tuple], block: int, width: int, hot: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(partition, (kind, block, payload)) of a block: docs are (doc_id, held out, word hashes)."""
    lengths = np.array([len(w) + 1 for _, _, w in docs], dtype=np.int64)
    words = np.concatenate([np.append(w, END) for _, _, w in docs])
    before = np.concatenate([np.concatenate([[START], w]) for _, _, w in docs]).astype(np.uint64)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), lengths)
    ids = np.array([0 if d[0] is None else d[0] for d in docs], dtype="<i8").tobytes()
    known = np.array([d[0] is not None for d in docs], dtype=np.uint8).tobytes()
    held = np.array([d[1] for d in docs], dtype=np.uint8).tobytes()
    yield block % width, (_DOCS, block, bundle(squeezed(ids), squeezed(known), squeezed(held), planes(lengths)))
    bucket = mixed(words)
    frequent = np.isin(words, hot)
    bucket[frequent] = mixed(words[frequent] ^ mixed(before[frequent]))
    bucket = (bucket % np.uint64(width)).astype(np.int64)
    unique, number = np.unique(words, return_inverse=True)
    contexts, context = np.unique(before, return_inverse=True)
    # entries by partition, word and context
    order = np.argsort(bucket << 48 | number << 24 | context, kind="stable")
    bucket, number, context, doc = bucket[order], number[order], context[order], doc[order]
    bounds = np.searchsorted(bucket, np.arange(width + 1))
    held = squeezed(held)
    for p in range(width):
        a, b = int(bounds[p]), int(bounds[p + 1])
        if a == b:
            continue
        own, first = np.unique(number[a:b], return_index=True)
        seen, at = np.unique(context[a:b], return_inverse=True)
        payload = bundle(
            held,
            _hash_bytes(unique[own]),
            planes(np.diff(np.append(first, b - a))),
            _hash_bytes(contexts[seen]),
            integers(at),
            integers(doc[a:b]),
        )
        yield p, (_ENTRIES, block, payload)


def _deal(width: int, hot: np.ndarray, block_bytes: int):
    def deal(part: int, rows: Iterator) -> Iterator[tuple[int, tuple]]:
        known, docs, size, at = WordHashes(), [], 0, 0
        for doc_id, held, text in rows:
            data = text.encode()
            docs.append((doc_id, held, word_hashes(data, known)))
            size += len(data) + 64
            if size >= block_bytes or len(docs) >= 65_000:
                yield from _block_rows(docs, part << 32 | at, width, hot)
                docs, size, at = [], 0, at + 1
        if docs:
            yield from _block_rows(docs, part << 32 | at, width, hot)

    return deal


# --- a partition of words ------------------------------------------------------------


def _look_up(width: int, hot: np.ndarray, hot_counts: np.ndarray):
    """Counts the bigrams of a partition and looks up all its entries."""

    def look_up(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        blocks, words, runs, contexts, ats, docs, held = [], [], [], [], [], [], []
        for _, (kind, block, payload) in rows:
            if kind == _DOCS:
                yield block % width, (kind, block, payload)
                continue
            h, w, run, c, at, d = unbundle(payload)
            blocks.append(block)
            held.append(np.frombuffer(unsqueezed(h), dtype=np.uint8))
            words.append(_u64(w))
            runs.append(from_planes(run).astype(np.int64))
            contexts.append(_u64(c))
            ats.append(from_integers(at))
            docs.append(from_integers(d).astype(np.int64))
        if not blocks:
            return
        unique, number = np.unique(np.concatenate(words), return_inverse=True)
        number = np.repeat(number.astype(np.uint32), np.concatenate(runs))
        vs, v_number = np.unique(np.concatenate(contexts), return_inverse=True)
        v_start = np.cumsum([0, *map(len, contexts)])
        context = np.concatenate([v_number[s + a.astype(np.int64)].astype(np.uint32) for s, a in zip(v_start, ats, strict=False)])
        del words, contexts, ats, v_number
        learned = np.concatenate([h[d] == 0 for h, d in zip(held, docs, strict=True)])
        pairs, pair = np.unique(number.astype(np.uint64) << np.uint64(32) | context, return_inverse=True)
        pair_counts = np.bincount(pair, weights=learned, minlength=len(pairs)).astype(np.int64)
        r = pair_counts[pair]
        del pair
        word_counts = np.bincount(number, weights=learned, minlength=len(unique)).astype(np.int64)
        place = np.searchsorted(hot, unique)
        place[place == len(hot)] = 0
        if len(hot):
            word_counts = np.where(hot[place] == unique, hot_counts[place], word_counts)

        # what a document's tokens add up to; block by block, as arrays over all entries are large
        log_base = np.log10(word_counts + 0.5)
        # as a context, a word's count divides whatever is seen after it
        divides = np.where((word_counts > 0) & (unique != END), -np.log10(np.maximum(word_counts, 1)), 0.0)
        ends = np.cumsum([0, *map(len, docs)])
        for i, (block, doc) in enumerate(zip(blocks, docs, strict=True)):
            s = slice(int(ends[i]), int(ends[i + 1]))
            word, times = number[s], r[s]
            large = np.where(times > LARGEST, math.log10(1 - KEPT_BACK), 0.0)
            values = log_base[word], np.log10(np.maximum(times, 1)) + divides[word] + large
            there, at = np.unique(doc, return_inverse=True)
            n = len(there)
            sums = [np.bincount(at, weights=x, minlength=n) for x in values]
            number_of = [np.bincount(at, weights=times == k, minlength=n) for k in range(1, LARGEST + 1)]
            number_of.append(np.bincount(at, weights=word_counts[word] > 0, minlength=n))
            payload = bundle(
                integers(there),
                *(squeezed(x.astype("<f8").tobytes()) for x in sums),
                planes(np.concatenate(number_of).astype(np.uint32)),
            )
            yield block % width, (_SCORED, block, payload)

        # what the contexts of seen pairs need to know
        seen = pair_counts > 0
        v, c2 = (pairs[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64), pair_counts[seen]
        c1 = word_counts[(pairs[seen] >> np.uint64(32)).astype(np.int64)]
        columns = []
        for c in (c2, c1):
            columns += [np.bincount(v, weights=c == k, minlength=len(vs)) for k in range(1, LARGEST + 1)]
            columns.append(np.bincount(v, weights=np.where(c > LARGEST, c, 0), minlength=len(vs)))
        home = (mixed(vs) % np.uint64(width)).astype(np.int64)
        any_seen = np.bincount(v, minlength=len(vs)) > 0
        order = np.flatnonzero(any_seen)[np.argsort(home[any_seen], kind="stable")]
        bounds = np.searchsorted(home[order], np.arange(width + 1))
        for q in range(width):
            at = order[bounds[q] : bounds[q + 1]]
            if len(at):
                yield q, (_CONTEXTS, 0, bundle(_hash_bytes(vs[at]), *(_long(c[at]) for c in columns)))

        # tokens not seen after their context
        new = np.flatnonzero(r == 0)
        of_block = np.repeat(np.arange(len(blocks)), np.diff(ends))[new]
        order = np.argsort(home[context[new]], kind="stable")
        new, of_block = new[order], of_block[order]
        doc = np.concatenate(docs)[new]
        bounds = np.searchsorted(home[context[new]], np.arange(width + 1))
        names = np.array(blocks, dtype="<i8").tobytes()
        for q in range(width):
            s = slice(int(bounds[q]), int(bounds[q + 1]))
            if s.start < s.stop:
                own, at = np.unique(context[new[s]], return_inverse=True)
                payload = bundle(
                    squeezed(names), _hash_bytes(vs[own]), integers(at), integers(of_block[s]), integers(doc[s]), _long(word_counts[number[new[s]]])
                )
                yield q, (_UNSEEN, 0, payload)

    return look_up


def _long(values: np.ndarray) -> bytes:
    """Counts, which may need more than 32 bits."""
    values = values.astype(np.uint64)
    return bundle(planes((values & np.uint64(0xFFFFFFFF)).astype(np.uint32)), planes((values >> np.uint64(32)).astype(np.uint32)))


def _from_long(data: bytes) -> np.ndarray:
    low, high = map(from_planes, unbundle(data))
    return low.astype(np.int64) | high.astype(np.int64) << 32


# --- a partition of contexts and documents ----------------------------------------------


def _contexts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and their 2 * (LARGEST + 1) sums over the words seen after them."""
    parts = [unbundle(p) for p in payloads]
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros((2 * LARGEST + 2, 0), dtype=np.int64)
    vs, at = np.unique(np.concatenate([_u64(p[0]) for p in parts]), return_inverse=True)
    sums = [
        np.bincount(at, weights=np.concatenate([_from_long(p[1 + i]) for p in parts]), minlength=len(vs)).astype(np.int64)
        for i in range(2 * LARGEST + 2)
    ]
    return vs, np.stack(sums)


def backoff(sums: np.ndarray, discount: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(count, backoff weight) of contexts from their sums."""
    times = np.arange(1, LARGEST + 1)[:, None]
    pair_small, pair_large, word_small, word_large = sums[:LARGEST], sums[LARGEST], sums[LARGEST + 1 : -1], sums[-1]
    count = (pair_small * times).sum(axis=0) + pair_large
    kept = (pair_small * times * discount[1:-1, None]).sum(axis=0) + discount[-1] * pair_large
    below = (word_small * times * words.discount[1:-1, None]).sum(axis=0) + words.discount[-1] * word_large
    return count, (1 - kept / count) / (1 - below / words.tokens)


def _count_of_counts(rows: Iterator) -> Iterator[np.ndarray]:
    """Numbers of bigrams that occur 1..LARGEST times, from the sums of a
    partition's contexts."""
    total = np.zeros(LARGEST, dtype=np.int64)
    for _, (kind, _block, payload) in rows:
        if kind == _CONTEXTS:
            parts = unbundle(payload)
            total += np.array([_from_long(parts[1 + i]).sum() for i in range(LARGEST)])
    yield total


def _finish(words: Words, discount: np.ndarray, learned_docs: int):
    def finish(rows: Iterator) -> Iterator[tuple]:
        contexts, unseen, docs, scored = [], [], {}, {}
        for _, (kind, block, payload) in rows:
            if kind == _CONTEXTS:
                contexts.append(payload)
            elif kind == _UNSEEN:
                unseen.append(payload)
            elif kind == _DOCS:
                docs[block] = payload
            else:
                scored.setdefault(block, []).append(payload)
        log_discount = np.log10(discount[1:-1])
        floor = math.log10(words.tokens + 0.5 * (words.words + 1))
        start = -math.log10(learned_docs) if learned_docs else 0.0
        for block, payload in docs.items():
            ids, known, held, lengths = unbundle(payload)
            ids, known = np.frombuffer(unsqueezed(ids), dtype="<i8"), np.frombuffer(unsqueezed(known), dtype=np.uint8)
            held, lengths = np.frombuffer(unsqueezed(held), dtype=np.uint8), from_planes(lengths).astype(np.int64)
            base, part, known_words = -floor * lengths, np.full(len(ids), start), np.zeros(len(ids), dtype=np.int64)
            for row in scored.pop(block, []):
                at, b, s, number_of = unbundle(row)
                at = from_integers(at).astype(np.int64)
                number_of = from_planes(number_of).reshape(LARGEST + 1, -1)
                base[at] += np.frombuffer(unsqueezed(b), dtype="<f8")
                part[at] += np.frombuffer(unsqueezed(s), dtype="<f8") + log_discount @ number_of[:-1]
                known_words[at] += number_of[-1]
            for i in range(len(ids)):
                yield (
                    block, i, int(ids[i]) if known[i] else None, bool(held[i]), int(lengths[i]), int(known_words[i]),
                    float(base[i]), float(part[i]),
                )
        if not unseen:
            return
        vs, sums = _contexts(contexts)
        count, weight = backoff(sums, discount, words) if len(vs) else (np.zeros(0), np.zeros(0))
        # the context's count was divided by although nothing was seen here
        worth = np.log10(weight) + np.log10(count)
        for payload in unseen:
            names, v, at, of_block, doc, word_count = unbundle(payload)
            v = _u64(v)
            place = np.searchsorted(vs, v)
            place[place == len(vs)] = 0
            found = vs[place] == v if len(vs) else np.zeros(len(v), dtype=bool)
            value = np.zeros(len(v))
            value[found] = worth[place[found]]
            value = value[from_integers(at)] + words.log_probability(_from_long(word_count))
            key, at = np.unique(from_integers(of_block).astype(np.int64) << 32 | from_integers(doc), return_inverse=True)
            names = np.frombuffer(unsqueezed(names), dtype="<i8")
            for k, total in zip(key.tolist(), np.bincount(at, weights=value).tolist(), strict=True):
                yield int(names[k >> 32]), k & 0xFFFFFFFF, None, None, None, None, None, total

    return finish


# --- the corpus ---------------------------------------------------------------------------


def word_table(rows: DataFrame) -> DataFrame:
    """(word, n): hashes and counts of the words of training texts, the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            unique, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                waiting.append(np.append(word_hashes(text.as_py(), known), END))
                size += len(waiting[-1])
                if size > 6_000_000:
                    yield counted()
                    waiting, size = [], 0
        if waiting:
            yield counted()

    counts = rows.where(~F.col("held_out")).select("text").mapInArrow(count, "word long, n long")
    return written(counts.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def katz_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that ``held_out`` does not hold for (null counts as
    false). Words are split at ASCII white space, A-Z in lower case; a null or
    empty text is its end alone. A null id stays null; repeated rows count and
    are scored once each. Without training rows all probabilities are 1. An
    empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    width = shuffle_width(spark)
    table = word_table(rows)
    tokens, n_words, *counts = table.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count(F.lit(1)),
        *(F.count_if(F.col("n") == r) for r in range(1, LARGEST + 1)),
    ).first()
    words = Words(dict(enumerate(counts, start=1)), tokens, n_words)
    end = table.where(F.col("word") == int(END)).first()
    # words with a quarter of a partition's tokens or more: 4 * width at most
    hot = table.where(F.col("n") * 4 * width >= tokens).collect()
    hot_words = np.array(sorted(r["word"] & 0xFFFFFFFFFFFFFFFF for r in hot), dtype=np.uint64)
    by_word = {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in hot}
    hot_counts = np.array([by_word[int(w)] for w in hot_words], dtype=np.int64)

    same = lambda p: p
    # an RDD, as its shuffle files serve both the counts of counts and the scores
    dealt = rows.rdd.mapPartitionsWithIndex(_deal(width, hot_words, block_bytes)).partitionBy(width, same)
    looked_up = dealt.mapPartitions(_look_up(width, hot_words, hot_counts)).partitionBy(width, same)
    numbers = sum(looked_up.mapPartitions(_count_of_counts).collect(), np.zeros(LARGEST, dtype=np.int64))
    discount = discounts(dict(enumerate(numbers.tolist(), start=1)))
    parts = spark.createDataFrame(
        looked_up.mapPartitions(_finish(words, discount, end["n"] if end else 0)),
        "block long, place long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        verifySchema=False,
    )
    whole = parts.groupBy("block", "place").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_known").alias("n_known"),
        F.max("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
