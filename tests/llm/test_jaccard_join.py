import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.llm import jaccard_join as jj
from retentia.llm.components import components
from retentia.llm.shingles import WordHashes, mixed, shingle_set, word_hashes

SCHEMA = "doc_id long, text string, row int, key string, size int, set_id int, component string, side int, text_hash int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "c", 4, 5) for i, t in rows], SCHEMA)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """[(doc_id, size, component id)] and the linked pairs of row numbers."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))
    links = set()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.add((b, a))
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        out.append((i, len(sets[n]), min(ids) if ids else None))
    return sorted(out, key=str), links


def mutated(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90, 300):
        for _ in range(4):
            base = [f"v{rng.randrange(60)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3):
                extra = " ".join(f"x{rng.randrange(9)}" for _ in range(rng.choice([0, 0, 1, size // 10])))
                rows.append((i, f"{mutated(base, rng, edits if size > 8 else edits // 2)} {extra}"))
                i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, " "), (None, rows[9][1]), (None, "alone here"), (3, "an id twice")]
    rows += [(i + 4, rows[100][1].upper()), (i + 5, rows[100][1].replace(" ", "\n  ")), (i + 6, "Z" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 512), (5, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jj, "BLOCK_SETS", block)
    rows = corpus(k)
    join = jj.JaccardJoin(docs(spark, rows).repartition(4, "doc_id"), k, percent)
    want, links = brute(rows, k, percent)
    got = join.result().collect()
    assert sorted(((r.doc_id, r.size, r.component_id) for r in got), key=str) == want
    # all links between different sets, from class representatives
    classes = {r.row: r for r in join.classes.collect()}
    sets = {frozenset(shingles(t, k)) for _, t in rows} - {frozenset()}
    assert len(classes) == len(sets)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in join.links().collect()}
    text_sets = [frozenset(shingles(t, k)) for _, t in rows]
    assert len(pairs) == len({frozenset((text_sets[a], text_sets[b])) for a, b in links if text_sets[a] != text_sets[b]})


def test_near_copies_in_distant_blocks_of_a_key_are_candidates(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(1300)]
    rows = list(enumerate(texts + [f"{t} more" for t in texts[:10]]))
    join = jj.JaccardJoin(docs(spark, rows).coalesce(1), 3, 80)
    # one key for all sets, as if they shared a common passage and nothing else
    join.sets = join.sets.withColumn("keys", F.array(F.lit(7).cast("long")))
    ids = {r.row: r.doc_id for r in join.sets.collect()}
    group = {ids[r.node]: ids[r.component] for r in components(join.candidates()).collect()}
    assert all(group[i] == group[1300 + i] for i in range(10))
    assert len(set(group.values())) == 10


def test_one_document_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(9, " ".join(base)), (4, " ".join(base[:-2])), (7, " ".join(base[2:])), (1, "other text"), (2, None), (3, ""), (None, "no id")]
    frame = docs(spark, rows)
    kept = jj.keep_one_per_group(frame)
    assert kept.schema == frame.schema
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "3", "4", "None"]


def test_empty_table(spark):
    join = jj.JaccardJoin(docs(spark, []))
    assert join.result().collect() == [] and join.links().collect() == []
    assert jj.keep_one_per_group(docs(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.floats(0, 0.3), st.floats(0, 0.3), st.sampled_from([80, 90]), st.integers(0, 10**6))
def test_similar_sets_share_a_region(size, lost, gained, percent, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(mixed(rng.integers(1, 1 << 60, size).astype(np.uint64)))
    y = x[rng.random(len(x)) >= lost]
    y = np.unique(np.concatenate([y, mixed(rng.integers(1, 1 << 60, int(gained * size)).astype(np.uint64))]))
    common = len(np.intersect1d(x, y))
    if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
        bands = jj.Bands(percent)
        assert len(np.intersect1d(jj.region_keys(x, bands), jj.region_keys(y, bands)))
    maps = jj.bitmaps([x, y], 64)
    sizes = np.array([len(x), len(y)])
    assert jj.overlap_bounds(maps[:1], sizes[:1], maps[1:], sizes[1:])[0, 0] >= common
    assert not len(y) or jj.overlap(x, y) == common


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 150)] + [(300, 300), (7, 3), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 150), 200]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_short_sequences_differ_from_shingles():
    hashes = word_hashes(b"A b", WordHashes())
    assert len(shingle_set(hashes, 3)) == 1 and len(shingle_set(hashes[:0], 3)) == 0
    longer = word_hashes(b"a b c", WordHashes())
    assert shingle_set(hashes, 3)[0] not in shingle_set(longer, 3)
    assert (word_hashes(b"a\x0bB", WordHashes()) == hashes).all()


def test_every_percent_links_sets_of_unlike_size(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(24):
        start = int(rng.integers(0, 12))
        rows.append((i, " ".join(f"w{j}" for j in range(start, start + int(rng.integers(1, 14))))))
    sets = [set(t.split()) for _, t in rows]
    for percent in (10, 34, 50, 66, 67, 90):
        got = jj.JaccardJoin(docs(spark, rows), words=1, percent=percent).result().collect()
        parent = list(range(len(rows)))
        for _ in rows:  # least reachable id
            for a in range(len(rows)):
                for b in range(len(rows)):
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        parent[a] = min(parent[a], parent[b])
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(parent)), percent


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text, 7, "x"), (2, text + " more", 8, "y"), (3, None, 9, "z")], "doc_id long, text string, _gone_id long, `a.b` string")
    assert sorted(map(tuple, jj.keep_one_per_group(frame).collect()), key=str) == [(1, text, 7, "x"), (3, None, 9, "z")]
