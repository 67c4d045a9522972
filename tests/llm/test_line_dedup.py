import random
import re

import numpy as np
import pyarrow as pa

from retentia.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, row int, hashes string, spans int, at int, start int, gram int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h", 2, 3, 4, 5) for i, t in rows], SCHEMA)


def brute(rows):
    """One row after another: every fingerprint against its first occurrence, extended piece by piece."""
    made = [ld.pieces(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    first, out = {}, {}
    for r in order:
        mine = made[r][0].tolist()
        dead = set()
        for at, gram in zip(*(x.tolist() for x in ld.fingerprints(made[r][0]))):
            if gram not in first:
                first[gram] = (r, at)
                continue
            x, origin = first[gram]
            other = made[x][0].tolist()
            a, b = at, at
            while a > 0 and origin - (at - a) > 0 and mine[a - 1] == other[origin - (at - a) - 1]:
                a -= 1
            while b < len(mine) and origin + (b - at) < len(other) and mine[b] == other[origin + (b - at)]:
                b += 1
            dead |= set(range(a, b))
        out[r] = (len(mine), sorted(dead))
    return [(rows[r][0], out[r][0], len(out[r][1])) for r in range(len(rows))]


def corpus(seed=3):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))
    passage, other = [line() for _ in range(7)], [line() for _ in range(4)]
    rows = []
    for i in range(120):
        own = [line() for _ in range(rng.randrange(0, 12))]
        at = rng.randrange(len(own) + 1)
        if i % 3 == 0:
            own[at:at] = passage[: rng.randrange(2, 8)]
        if i % 5 == 0:
            own[at:at] = other
        rows.append((i, rng.choice([".\n", ". ", "\n", "! "]).join(own)))
    rows += [(500, None), (501, ""), (502, " \n ."), (503, "same\n" * 50), (504, "a. b. a. b. a. b."), (None, rows[0][1]), (3, rows[3][1])]
    return rows + [(600, "x" * 200_000 + ". " + ". ".join(passage)), (601, rows[10][1]), (602, rows[10][1])]


def test_runs_equal_brute_force(spark):
    rows = corpus()
    got = ld.repeated_runs(docs(spark, rows).coalesce(1)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_deleted) for r in got))) == sorted(map(str, brute(rows)))
    texts = {i: t for i, t in rows if i not in (None, 3)}
    for r in got:
        if r.doc_id in texts:
            left = ld.without(texts[r.doc_id] or "", [(s.start, s.end) for s in r.spans])
            assert len(ld.pieces(left)[0]) <= r.n_lines - r.n_deleted + len(r.spans)
    gone = {r.doc_id: (r.n_lines, r.n_deleted) for r in got}
    assert gone[602][1] >= gone[602][0] - 1 and gone[500] == (0, 0)


def test_long_passages_are_found_wherever_they_stand(spark):
    passage = ". ".join(" ".join(f"p{i}x{j}" for j in range(11)) for i in range(6))
    rows = [(i, f"own{i} text. more{i} of it {passage}. the end{i}") for i in range(40)] + [(99, "clean text. of its own. nothing else")]
    got = {r.doc_id: r for r in ld.repeated_runs(docs(spark, rows).repartition(5, "doc_id")).collect()}
    assert got[0].n_deleted == 0 and got[99].n_deleted == 0
    assert all(got[i].n_deleted >= 5 for i in range(1, 40))


def test_empty_table(spark):
    assert ld.repeated_runs(docs(spark, [])).collect() == []


def test_every_window_has_a_fingerprint():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 9, 300).astype(np.uint64)
    at, _ = ld.fingerprints(hashes)
    assert np.diff(at).max() <= ld.WINDOW and at[0] < ld.WINDOW and at[-1] >= len(hashes) - ld.GRAM + 1 - ld.WINDOW


def test_repeats_of_over_50_words_go_whatever_their_pieces(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one_line, sentences = fresh(60), fresh(55)
    sentences[20] += "."  # two pieces, both run into the text around them
    rows = []
    for i in range(30):
        passage = (one_line, sentences, fresh(70), one_line[3:57])[i % 4]
        rows.append((i, " ".join(fresh(rng.randrange(1, 40)) + passage + fresh(rng.randrange(1, 40)))))
    rows += [(50, " ".join(one_line) + "\u00a0\u2003tail"), (51, "é\U0001f600 " + "  ".join(sentences)), (52, " ".join(fresh(30) * 4))]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in ld.repeated_runs(docs(spark, rows).repartition(4, "doc_id")).collect()}
    # independent: every word of a run of 51 that an earlier place holds
    seen = set()
    for i, text in rows:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        runs = [tuple(text[a:b] for a, b in words[k : k + 51]) for k in range(len(words) - 50)]
        must = set()
        for k, run in enumerate(runs):
            if run in seen:
                must |= set(range(k, k + 51))
            seen.add(run)
        gone = {k for k, (a, b) in enumerate(words) if any(s <= a and b <= e for s, e in got[i])}
        assert must == gone, i
    assert got[52] and got[0] == [] and got[1] == []


def test_arrays_travel_only_for_rows_of_a_match(spark, monkeypatch):
    rows = [(i,) for i in (0, 5, 63, 64, 200, (3 << 33) + 1, (3 << 33) + 64)]
    table = spark.createDataFrame(rows, "row long")
    some = spark.createDataFrame([(5, True), (5, False), (63, False), ((3 << 33) + 64, True)], "row long, w boolean")
    flagged = lambda: {r.row: (r.any, r.word) for r in ld._flagged(table, some, {"any": ld.F.lit(True), "word": ld.F.col("w")}).collect()}
    want = {5: (True, True), 63: (True, False), (3 << 33) + 64: (True, True)}
    assert flagged() == {r: want.get(r, (False, False)) for (r,) in rows}
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    assert set(flagged().values()) == {(True, True)}
    same = corpus()
    got = lambda: sorted(map(str, ld.repeated_runs(docs(spark, same).coalesce(1)).collect()))
    every = got()
    monkeypatch.undo()
    assert got() == every


def _batches(texts, size):
    rows = [7 * i for i in range(len(texts))]
    table = pa.table({"row": pa.array(rows, pa.int64()), "doc_id": pa.array([None if i % 5 == 0 else i for i in rows], pa.int64()), "text": pa.array(texts)})
    return table.combine_chunks().to_batches(max_chunksize=size)


def test_fingerprints_travel_as_blocks_and_are_those_of_single_texts(monkeypatch):
    rng = random.Random(9)
    odd = ["", " ", ".", "..a", "a\n.b", "é\U0001f600 x. 　y z", "\n\n", "a.b.c!?d", "a\x1cb\x85c. q", "x" * 300 + " y"]
    odd += ["".join(rng.choice(" \t\n.!?abé\U0001f600　。\r") for _ in range(rng.randrange(300))) for _ in range(60)]
    texts = [t or "" for _, t in corpus()] + odd + [" ".join(rng.choice("abc") for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    for chars, prints in ((1 << 18, 1 << 20), (500, 300)):
        monkeypatch.setattr(ld, "CHUNK_CHARS", chars)
        monkeypatch.setattr(ld, "BLOCK_PRINTS", prints)
        made = pa.Table.from_batches(ld._described(iter(_batches(texts, 50)), 4)).to_pylist()
        described, blocks = [r for r in made if r["bucket"] is None], [r for r in made if r["bucket"] is not None]
        found = {r["row"]: set() for r in described}
        for r in blocks:
            row, no_id, doc_id, place = ld.unbundle(r["block"])
            ids = [None if x else i for x, i in zip(np.frombuffer(ld.unsqueezed(no_id), bool), ld._from_steps(doc_id).tolist(), strict=True)]
            for gram, x, i, at in zip(np.frombuffer(r["grams"], np.uint64).tolist(), ld._from_steps(row).tolist(), ids, ld.from_planes(place).tolist(), strict=True):
                assert i == (None if x % 5 == 0 else x) and (x, at) not in found
                found[x].add((at, gram))
        dealt = [sum(len(r["grams"]) for r in blocks if r["bucket"] == i) for i in range(4)]
        assert max(dealt) < 2 * min(dealt)
        # no row of its own for each fingerprint
        assert len(blocks) < sum(map(len, found.values())) / (10 if prints > 300 else 2)
        for text, r in zip(texts, described, strict=True):
            hashes, starts, ends = ld.pieces(text)
            at, gram = ld.fingerprints(hashes)
            a, b, first, last = ld._layout(len(hashes), r["layout"])
            assert r["hashes"] == hashes.tobytes() and a.tolist() == starts.tolist() and b.tolist() == ends.tolist()
            words = [(m.start(), m.end()) for x, y in zip(starts.tolist(), ends.tolist(), strict=True) for m in re.compile(r"\S+").finditer(text, x, y)]
            assert list(zip(first.tolist(), last.tolist(), strict=True)) == words
            assert {x for x in found[r["row"]] if x[0] % 2 == 0} == set(zip((2 * at).tolist(), gram.tolist(), strict=True))
            # of words: one place in each window of grams, none without a gram
            places = sorted(x // 2 for x, _ in found[r["row"]] if x % 2)
            n = len(words) - ld.WORD_GRAM + 1
            assert bool(places) == (n > 0)
            assert not places or np.diff([-1, *places, n]).max() <= ld.WORD_WINDOW


def test_runs_of_all_pairs_at_once_equal_single_extensions():
    rng = np.random.default_rng(4)
    kind = np.dtype("<u4")
    laters = [rng.integers(0, 2, rng.integers(0, 120)).astype(kind) for _ in range(40)]
    firsts = [np.concatenate([x[len(x) // 3 :], rng.integers(0, 2, rng.integers(0, 60)).astype(kind)]) for x in laters]
    matches, want = [], []
    for i, (x, y) in enumerate(zip(laters, firsts, strict=True)):
        mine = {(a, b) for a, b in rng.integers(0, 120, (30, 2)).tolist() if a < len(x) and b < len(y)}
        matches += [(i, a, b) for a, b in mine]
        reached, runs = {}, set()
        for a, b in sorted(mine):
            if a >= reached.get(a - b, 0):
                start, end, d = a, a, b - a
                while start > 0 and start + d > 0 and x[start - 1] == y[start + d - 1]:
                    start -= 1
                while end < len(x) and end + d < len(y) and x[end] == y[end + d]:
                    end += 1
                reached[a - b] = end
                runs.add((start, end))
        want.append(sorted(runs))
    rng.shuffle(matches)
    pair, at, origin = np.array(matches).T
    got = ld._runs(pair, at, origin, [x.tobytes() for x in laters], [x.tobytes() for x in firsts], kind)
    assert [[tuple(r) for r in np.frombuffer(x, kind).reshape(-1, 2).tolist()] for x in got] == want
