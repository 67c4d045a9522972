import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from retentia.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score string, votes int, lang string, toxic int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "en", 1) for i, t in rows], SCHEMA)


def corpus(n=1500, seed=4):
    """Texts of invented words; a tenth holds insults, half of those made of a stem no lexicon has."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "no", "ri", "te", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        toxic = i % 10 == 0
        if toxic:
            insult = rng.choice(["idiot", "pathetic", "scum"]) if i % 20 else "zorgu" + rng.choice(["ba", "no", "ri"])
            words.insert(rng.randrange(len(words)), insult)
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_finds_held_out_texts(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = tx.fit_toxicity(docs(spark, rows), marks)
    assert any(s.startswith("zorg") for s in model.stems)
    got = {r.doc_id: r for r in tx.score_toxicity(docs(spark, rows), model).collect()}
    for i, toxic, _ in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
    held = [i for i, _, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.98 * len(held)
    kept = tx.keep_clean(docs(spark, rows), model)
    assert kept.schema == docs(spark, rows).schema
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows, labels = corpus(400)
    lied = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels]
    scores = []
    for marks in (labels, lied):
        model = tx.fit_toxicity(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int, quality int"))
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in tx.score_toxicity(docs(spark, rows), model).collect()))
    assert scores[0] == scores[1]


def test_nulls_empty_long_repeated_and_unlabelled(spark):
    rows = [(1, None), (2, ""), (None, "idiot"), (None, None), (3, "fine " * 100_000), (4, "an idiot"), (4, "an idiot"), (5, "\u0000\n")]
    marks = spark.createDataFrame([(1, None, 1), (None, 1, 1), (4, 0, 1), (4, 1, 1), (99, 1, 0)], "doc_id long, toxic int, quality int")
    for labels in (marks, marks.limit(0)):
        model = tx.fit_toxicity(docs(spark, rows), labels)
        got = tx.score_toxicity(docs(spark, rows), model).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
        empty = {r.score for r in got if r.doc_id in (1, 2, 5)}
        assert len(empty) == 1 and empty.pop() < 0.5
    nothing = docs(spark, [])
    assert tx.score_toxicity(nothing, tx.fit_toxicity(nothing, marks)).collect() == []


def test_label_model_recovers_voters_and_correlation():
    rng = np.random.default_rng(2)
    n = 20_000
    y = rng.random(n) < 0.2
    votes = np.zeros((n, len(tx.VOTERS)), dtype=int)
    for j, (hit, miss) in enumerate([(0.8, 0.01), (0.6, 0.02), (0.7, 0.05), (0.5, 0.02)]):
        votes[:, j] = rng.random(n) < np.where(y, hit, miss)
    votes[:, 4] = votes[:, 3]  # repeats another voter
    masks = (votes << np.arange(votes.shape[1])).sum(axis=1)
    labels = np.where(rng.random(n) < 0.2, y, -1)
    rows, counts = np.unique(np.stack([masks, labels]), axis=1, return_counts=True)
    model = tx.fit_label_model(rows[0], rows[1], counts.astype(float))
    assert abs(model.rates[1][0] - 0.8) < 0.05 and abs(model.rates[0][2] - 0.05) < 0.02 and abs(model.share - 0.2) < 0.03
    assert model.correlations[3, 4] > 0.9 and model.weights[3] < 0.6 < model.weights[0]
    alone = tx.fit_label_model(rows[0], np.full(rows.shape[1], -1), counts.astype(float))
    assert alone.rates[1][0] > 0.5 > alone.rates[0][0]


def test_no_columns_but_the_text_matter(spark):
    rows, labels = corpus(300)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = tx.fit_toxicity(docs(spark, rows), marks)
    other = docs(spark, rows).withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 10_000)
    a = sorted((r.doc_id, r.score) for r in tx.score_toxicity(docs(spark, rows), model).collect())
    b = sorted((r.doc_id - 10_000, r.score) for r in tx.score_toxicity(other, model).collect())
    assert a == b


def test_samples_of_huge_tables_have_their_size(spark):
    keys = spark.range(200_000)
    for of in (200_000, 10**7, 10**13):
        part = keys.where(tx._sampled(F.col("id"), of // 100, of)).count()
        assert 1_700 < part < 2_300
    # 6,000 of 10**13: the bound is not zero
    assert keys.where(tx._sampled(F.col("id"), 6_000, 10**13)).count() == 0
    assert "false" not in str(tx._sampled(F.col("id"), 6_000, 10**13)).lower()
    bound = (6_000 << 64) // 10**13
    assert f"{bound - (1 << 63)}" in str(tx._sampled(F.col("id"), 6_000, 10**13)) and bound > 10**9


def test_without_training_texts_the_posterior_scores(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "an idiot and a pathetic moron" if n % 10 == 0 else "a fine day") for n, i in enumerate(ids)]
    marks = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = tx.fit_toxicity(docs(spark, rows), marks)
    got = {r.doc_id: r for r in tx.score_toxicity(docs(spark, rows), model).collect()}
    masks = np.array([tx.Voters(model.stems).votes(t, tx._words(t)) for _, t in rows])
    want = model.label_model.posterior(tx.unpacked(masks).astype(float))
    assert all(abs(got[i].score - p) < 1e-9 for (i, _), p in zip(rows, want, strict=True))
    assert {got[i].predicted for i, t in rows if "fine" in t} == {0}


def test_prechecks_agree_with_the_bare_patterns():
    texts = ["just go die.", "GO DIE", "go d\u0131e", "go d\u0130e", "go kill yourself", "go kill your\u017felf", "we'll find you", "I hate you"]
    texts += ["you are an oaf", "you're so odd", "an i**t", "AAA BBB CCC DDD EEE FFF ", "die well", "a fine day"]
    for text in texts:
        for name, pattern in tx._COMPILED.items():
            assert not pattern.search(text) or tx._may_match(name, text, tx._words(text)), (name, text)
    assert all(any(p.search(t) for t in texts) for p in tx._COMPILED.values())


def test_kept_rows_have_columns_of_any_name(spark):
    rows = [(i, "you pathetic idiot" if i % 4 == 0 else "a fine day", f"k{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int")
    kept = tx.keep_clean(frame, tx.fit_toxicity(frame, marks))
    assert kept.columns == frame.columns and {r["a.b"] for r in kept.collect()} == {f"k{i}" for i in range(200) if i % 4}
    assert tx.keep_clean(frame.where("false"), tx.fit_toxicity(frame, marks)).count() == 0
