import hashlib
import random
import zlib

import numpy as np
import pytest

from retentia.llm.periodic_runs import CommonExtensions, live_stretches, periodic_runs, runs_of
from retentia.llm.queries import QUERIES, with_repeated_tails

SF = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """(start, length, period) by comparing the words of every distance."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            e = i + p
            shorter = any(all(words[k] == words[k + q] for k in range(s, e - q)) for q in range(1, p))
            if e - s >= max(least, exponent * p) and not shorter:
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words, letters = [], rng.randint(1, 4)
        for _ in range(rng.randint(0, 6)):
            root = [str(rng.randint(0, letters)) for _ in range(rng.randint(1, 7))]
            words += (root * 7)[: rng.randint(0, 6 * len(root))] if rng.random() < 0.5 else root
        yield words


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (3, 3), (12, 2)])
def test_operator_equals_brute_force(spark, least, exponent):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts(5, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in periodic_runs(docs, least=least, exponent=exponent).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = text.split()
        want = brute(words, least, exponent)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want
        assert got[i].collapsed == collapsed(words, want) and got[i].n_words == len(words)


def test_common_extensions():
    rng = np.random.default_rng(3)
    text = [*rng.integers(0, 3, 200).tolist(), 3]
    tree = CommonExtensions(text, 4)
    assert tree.order.tolist() == sorted(range(201), key=lambda i: text[i:])
    a, b = rng.integers(0, 201, 500), rng.integers(0, 201, 500)
    a, b = a[a != b], b[a != b]
    for i, j, common in zip(a.tolist(), b.tolist(), tree.of(a, b).tolist()):
        want = next(k for k in range(201) if text[i + k] != text[j + k])
        assert common == want


def test_stretches_lose_no_run():
    rng = np.random.default_rng(8)
    words = np.concatenate([rng.integers(0, 400, 3000), np.tile([1, 2, 3], 4), rng.integers(0, 400, 3000), [7] * 6, [8] * 5])
    starts, ends = live_stretches(words, np.array([0, 2000, len(words)]), 6, 4)
    assert int((ends - starts).sum()) < 100  # prose goes
    home, start, length, period = runs_of([words[s:e] for s, e in zip(starts, ends)], 6, 4)
    found = sorted(zip((start + starts[home]).tolist(), length.tolist(), period.tolist()))
    assert found == brute(words[:2000].tolist()) + [(s + 2000, n, p) for s, n, p in brute(words[2000:].tolist())]


def test_nulls_white_space_repeats_and_clashing_columns(spark):
    long = " ".join(["again and"] * 30_000)
    rows = [
        (1, None, 7),
        (2, "", 7),
        (3, " \t\n\x0b\x0c\r ", 7),
        (4, "a\tb  a b a b a\nb a b a b ", 7),  # a no-break space is part of a word
        (None, "x x x x x x", 7),
        (5, "same same same same same same", 7),
        (5, "same same same same same same", 7),
        (6, long, 7),
        (7, "one word", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "collapsed")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == sorted(
        [
            ("1", 0, [], ""),
            ("2", 0, [], ""),
            ("3", 0, [], ""),
            ("4", 11, [(3, 8, 2)], "a b a b a b"),
            ("None", 6, [(0, 6, 1)], "x"),
            ("5", 6, [(0, 6, 1)], "same"),
            ("5", 6, [(0, 6, 1)], "same"),
            ("6", 60_000, [(0, 60_000, 2)], "again and"),
            ("7", 2, [], "one word"),
        ]
    )


def test_empty_table_and_other_names(spark):
    empty = spark.createDataFrame([], "`a.b` string, body string")
    assert periodic_runs(empty, "a.b", "body").collect() == []
    one = spark.createDataFrame([("k", "z z z z z z")], "`a.b` string, body string")
    assert periodic_runs(one, "a.b", "body").first().collapsed == "z"


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    rewritten = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        words, n, h = [w.decode() for w in words], len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            rewritten += 1
        runs = brute(words) if n < 3000 else None
        r = got[doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert rewritten > 5


def test_rewritten_texts_keep_every_row(spark):
    rows = [(i, t) for i in range(40) for t in ("a b c d e f g h", "", None)] + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = with_repeated_tails(docs).collect()
    assert len(done) == len(rows) and (None, "x y") in [tuple(r) for r in done]
