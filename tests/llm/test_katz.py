import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import katz

SCHEMA = "doc_id long, text string, held_out string, word int, n string, block int, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], SCHEMA)


class Brute:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for words in texts:
            self.words.update(words)
            self.pairs.update(zip([0, *words[:-1]], words))
        self.n = sum(self.words.values())
        self.d1, self.d2 = katz.discounts(Counter(self.words.values())), katz.discounts(Counter(self.pairs.values()))
        self.unknown = 1 - sum(self.kept(self.d1, c) for c in self.words.values()) / self.n if self.n else 1.0
        self.after = defaultdict(list)
        for (v, w), c in self.pairs.items():
            self.after[v].append((w, c))

    def kept(self, d, c):
        return d[min(c, katz.LARGEST + 1)] * c

    def word(self, w):
        return self.kept(self.d1, self.words[w]) / self.n if self.words[w] else self.unknown

    def probability(self, v, w):
        if v not in self.after:
            return self.word(w)
        total = sum(c for _, c in self.after[v])
        if (v, w) in self.pairs:
            return self.kept(self.d2, self.pairs[v, w]) / total
        left = 1 - sum(self.kept(self.d2, c) for _, c in self.after[v]) / total
        return left / (1 - sum(self.word(x) for x, _ in self.after[v])) * self.word(w)

    def row(self, words):
        pairs = list(zip([0, *words[:-1]], words))
        base = sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for w in words)
        score = sum(math.log10(self.probability(v, w)) for v, w in pairs)
        return len(words), sum(self.words[w] > 0 for w in words), self.n, base, score


def split(text):
    return [*(text or "").encode().lower().split(), None]


def compared(spark, rows, block_bytes=300, **how):
    held = lambda i: i is not None and i % 5 == 1
    model = Brute([split(t) for i, t in rows if not held(i)])
    got = katz.katz_scores(docs(spark, rows).repartition(3, "text"), F.col("doc_id") % 5 == 1, block_bytes=block_bytes, **how).collect()
    want = sorted((str(i), held(i), *model.row(split(t))) for i, t in rows)
    assert len(got) == len(rows)
    for a, r in zip(want, sorted((str(r.doc_id), *r[1:]) for r in got)):
        assert a[:5] == r[:5] and r[5:] == pytest.approx(a[5:], rel=1e-9, abs=1e-9)
    return model


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=share / share.sum()))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1006, "Never SEEN w1 W1\nW2"), (None, "no id w1"), (7, "twice w3"), (7, "twice w3")]
    return rows + [(2000, "hot pair " * 3000), (2001, "hot pair " * 2000)]


def test_scores_equal_brute_force(spark):
    model = compared(spark, corpus())
    every = [*model.words, b"unknown"]
    for v in (b"w0", b"w250", b"hot", 0):
        assert sum(model.probability(v, w) for w in every) == pytest.approx(1.0)


def test_without_training_rows_and_empty_table(spark):
    compared(spark, [(1, "a b"), (6, None)])
    compared(spark, [(2, None)])
    assert katz.katz_scores(docs(spark, []), F.lit(False)).collect() == []


def test_discounts_stay_between_0_and_1():
    for counts in ({}, {1: 1}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 5, 2: 50}, {3: 7}):
        d = katz.discounts(counts)
        assert len(d) == katz.LARGEST + 2 and d[0] == 0 and all(0 < x < 1 for x in d[1:])
    turing = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})
    common = 6 * 6 / 100
    assert turing[1] == pytest.approx((2 * 40 / 100 - common) / (1 - common))
