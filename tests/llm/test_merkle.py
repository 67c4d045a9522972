import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from retentia.llm.merkle import folded, leaf_digest, merkle_manifest

SCHEMA = "doc_id long, source string, text string"
FIELDS = ("doc_id", "source", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def brute(rows):
    """(id, group, leaf, subroot, root, proof) of every row, trees built in memory."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, digest(*map(field, row))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf for *_, leaf in sorted(groups[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    return [
        (i if known else None, s, leaf, trees[s][-1][0], top[-1][0], path(trees[s], at) + path(top, number))
        for number, s in enumerate(names)
        for at, (known, i, leaf) in enumerate(sorted(groups[s]))
    ]


def manifest_of(spark, rows, partitions=3, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).repartition(partitions)
    return merkle_manifest(docs, [F.col(c) for c in FIELDS])


def proofs(manifest, requests=None):
    out = []
    for r in manifest.proofs(requests).collect():
        steps = [(s.before.hex(), s.after.hex()) for s in r.proof]
        out.append((r["id"], r["group"], r.digest.hex(), r.subroot.hex(), manifest.root.hex(), steps))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"hot": 600, "é": 33, "z": 256, None: 2, "": 5}])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(i * 7 % 1000, s, f"text {i} of {s}") for s, n in sizes.items() for i in range(n)]
    assert proofs(manifest_of(spark, rows)) == sorted(brute(rows), key=str)


def test_many_groups(spark):
    rows = [(i, f"host{i % 300}", "x" * (i % 5)) for i in range(900)]
    assert proofs(manifest_of(spark, rows)) == sorted(brute(rows), key=str)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, None, None), (None, "a", "x"), (3, "a", None), (3, "a", ""), (-1, "a", "-"), (1, "a", "0:"), (1, None, "é" * 9)]
    rows += [(5, "a", "same")] * 40  # whole subtrees are equal
    assert proofs(manifest_of(spark, rows)) == sorted(brute(rows), key=str)


def test_long_text_and_empty_table(spark):
    rows = [(1, "a", "long " * 400_000), (2, "a", "short")]
    assert proofs(manifest_of(spark, rows)) == sorted(brute(rows), key=str)
    empty = manifest_of(spark, [])
    assert empty.root is None and empty.proofs().collect() == []


def test_requests_for_some_leaves(spark):
    rows = [(i, f"s{i % 3}", "t") for i in range(800)] + [(5000 + i, f"t{i}", "u") for i in range(40)]
    manifest = manifest_of(spark, rows)
    wanted = {17, 18, 600, 5003}
    got = proofs(manifest, manifest.leaves.where(F.col("id").isin(*wanted)))
    assert got == sorted((r for r in brute(rows) if r[0] in wanted), key=str)


def test_clashing_columns_are_carried_or_ignored(spark):
    rows = [(i, "s", f"t{i}", i * 10, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, digest long, `a.b` string")
    docs = docs.select("*", F.lit(1).alias("tree"), F.lit(2).alias("rank"), F.lit(3).alias("part"), F.lit(4).alias("name"))
    manifest = merkle_manifest(docs, [F.col(c) for c in FIELDS], keep=[F.col("digest").alias("mine"), F.col("`a.b`").alias("other")])
    assert {(r["id"], r.mine, r.other) for r in manifest.proofs().collect()} == {(r[0], r[3], r[4]) for r in rows}
    assert proofs(manifest) == sorted(brute([r[:3] for r in rows]), key=str)


def test_records_lead_from_digest_to_children(spark):
    manifest = manifest_of(spark, [(i, "s", str(i)) for i in range(300)])
    nodes = [r for level in manifest.records for r in level.collect()]
    assert [sum(r.above == a for r in nodes) for a in (3, 2, 1)] == [19, 2, 1]
    for r in nodes:
        assert hashlib.sha256(r.children.hex().encode()).digest() == r.digest


def test_folding_finds_tampered_leaves(spark):
    rows = [(i, f"s{i % 2}", f"Text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(F.col("doc_id"), F.col("source"), F.lower("text")))
    manifest = merkle_manifest(docs, [F.col(c) for c in FIELDS], keep=[changed.alias("changed")])
    done = manifest.proofs().select("id", folded(F.coalesce("changed", "digest"), F.col("proof")).alias("root")).collect()
    broken = {r["id"] for r in done if r.root != manifest.root.hex()}
    assert broken == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0} and broken
