import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retentia.llm import vocabulary
from retentia.llm.crc import crc_after
from retentia.llm.packing import combinations, nnls, pack, packing_plan, plan_slots

SCHEMA = "doc_id long, text string, start int, length string, place int, bucket int, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], SCHEMA)


def checked(pieces, rows, window=2048):
    """Every id of every document lies in one piece, in order, with its checksum."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary.located(vocabulary.JSON_FILE))
    tokenizer.encode_special_tokens = True
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    total = 0
    for i, texts in want.items():
        own = [p for p in pieces if p.doc_id == i]
        assert sum(p.length for p in own) == sum(map(len, texts))
        for ids in texts:
            total += len(ids)
            at = 0
            while at < len(ids):
                crc = lambda p: zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())  # noqa: B023, E731
                p = next(p for p in own if p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(p))
                own.remove(p)
                at += p.length
            assert at == len(ids)
        assert not own
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    return 1 - total / (len(sequences) * window) if sequences else 0.0


def test_pieces_are_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "token " * int(n)) for i, n in enumerate(rng.integers(0, 3000, 150))]
    rows += [(1000 + i, "the same length here " * 371) for i in range(120)]  # a hot class
    rows += [(2000, None), (2001, ""), (2002, "x " * 30_000), (2003, "<|endoftext|>"), (None, "no id"), (5, "again"), (5, "again")]
    assert checked(pack(docs(spark, rows).repartition(4, "doc_id")).collect(), rows) < 0.03


def test_small_window_and_empty_table(spark):
    rows = [(i, "a b c d e f g " * i) for i in range(12)]
    checked(pack(docs(spark, rows), window=64, unit=4).collect(), rows, window=64)
    assert pack(docs(spark, [])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5), st.binary(max_size=300))
def test_checksum_of_an_ending(heads, tail):
    whole = np.array([zlib.crc32(h + tail) for h in heads], dtype=np.uint32)
    prefix = np.array([zlib.crc32(h) for h in heads], dtype=np.uint32)
    got = crc_after(whole, prefix, np.full(len(heads), len(tail)))
    assert got.tolist() == [zlib.crc32(tail)] * len(heads)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_least_squares_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (8, 14)).astype(float), rng.integers(0, 30, 8).astype(float)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max(initial=0) <= 1e-6 * max(1, np.abs(a.T @ b).max())
    assert abs(slope[x > 0]).max(initial=0) <= 1e-6 * max(1, np.abs(a.T @ b).max())


def test_plan_uses_no_more_than_there_is():
    assert sorted(combinations(4)) == [(2, 1, 1), (2, 2), (3, 1), (4,)]
    rng = np.random.default_rng(5)
    histogram = {c: int(n) for c, n in zip(range(1, 65), rng.integers(0, 500, 64))}
    plan = packing_plan(histogram, 64)
    used = {}
    for combination, repeats in plan:
        assert sum(combination) == 64 and repeats > 0
        for x in combination:
            used[x] = used.get(x, 0) + repeats
    assert all(n <= histogram[c] for c, n in used.items())
    units = sum(c * n for c, n in histogram.items())
    best = min(units, sum(n for n in histogram.values()) * 64)
    assert sum(repeats for _, repeats in plan) * 64 > 0.6 * best
    taken = sorted((c, a, b) for c, a, b, _, _ in plan_slots(plan))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(taken, taken[1:]))
    assert packing_plan({}, 64) == []
