"""Registered queries against their SQL, and the pipeline against its parts."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from retentia.llm.oracle_sql import ORACLES
from retentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 4


@pytest.fixture
def folder(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[(i * 37) % 300 :][:60] + [f"own{i}x{j}" for j in range(80)]), "en", f"s{i}", 1) for i in range(60)]
    rows += [(100 + i, f"plain text {i} " * 8 + ("you idiot" if i % 2 else "good day"), "en", "s", 1) for i in range(60)]
    rows += [(200 + i, rows[3][1].replace(" ", "  " * (i + 1)), "en", "s", 1) for i in range(5)]  # equal texts
    near = rows[7][1].split(" ")
    rows += [(300 + i, " ".join([*near[: 30 + i], f"edit{i}", *near[31 + i :]]), "en", "s", 1) for i in range(4)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_pipeline_stages(spark, folder):
    path, rows = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if n < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(out := f"{path}/stage{n}")
            docs = spark.read.parquet(out)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    every = {r[0] for r in rows}
    toxic = {r[0] for r in rows if "idiot" in (r[1] or "")}
    assert kept["toxicity"] == every - toxic
    # 400 and 401 are both empty
    assert kept["exact dedup"] == every - toxic - {200, 201, 202, 203, 204, 401}
    assert kept["n-gram Jaccard join"] == kept["exact dedup"] - {300, 301, 302, 303} - {100 + i for i in range(0)}
    assert kept["packing"] == kept["n-gram Jaccard join"]


def test_pipeline_run_is_its_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got[0].asDict())
    assert os.path.isdir(f"{path}/documents.parquet")
