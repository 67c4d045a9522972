import hashlib
import re
from collections import Counter

import pyarrow as pa

from retentia.llm.exact_dedup import _merge, dedup_decisions, deduplicate, frequent

SCHEMA = "doc_id long, text string, digest string, row int, kept string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "d", n, "k", 7) for n, (i, t) in enumerate(rows)], SCHEMA)


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out = []
    for d, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), first, d))
            first = False
    return sorted(out, key=str)


ROWS = (
    [(i, "same  text\nhere") for i in range(100, 160)]  # a heavy group
    + [(50, "same text\there")]
    + [(i, f"text {i % 7}") for i in range(30)]
    + [(200, None), (201, ""), (202, " "), (203, "\x0b\x0c"), (204, "\u00a0"), (None, "text 3"), (None, "alone")]
    + [(60, "twice"), (60, "twice"), (61, "twice"), (70, "x" * 300_000), (71, "x" * 300_000 + " "), (None, "alone")]
)


def test_decisions_equal_brute_force_with_few_and_many_counters(spark):
    for k in (1, 2, None):
        got = dedup_decisions(table(spark, ROWS), k=k).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=str) == brute(ROWS)


def test_rows_that_stay_keep_their_columns(spark):
    docs = table(spark, ROWS)
    kept = deduplicate(docs)
    assert kept.schema == docs.schema
    want = sorted(((i, d) for i, _, _, stays, d in brute(ROWS) if stays), key=str)
    assert sorted(((r.doc_id, digest(r.text)) for r in kept.collect()), key=str) == want


def test_empty_table(spark):
    assert dedup_decisions(table(spark, [])).collect() == []
    assert deduplicate(table(spark, [])).collect() == []


def test_summary_never_loses_a_frequent_key(spark):
    keys = [b"a"] * 40 + [b"b"] * 30 + [bytes([i]) * 2 for i in range(60)]
    counts = _merge({}, dict(Counter(keys)), 4)
    assert counts[b"a"] >= 40 - len(keys) // 5 and counts[b"b"] >= 30 - len(keys) // 5 and len(counts) <= 4
    frame = spark.createDataFrame(pa.table({"k": pa.array(keys, pa.binary())}).to_pandas(), "k binary").repartition(5)
    got = {bytes(r.k) for r in frequent(frame, 4).collect()}
    assert b"a" in got and len(got) <= 4
