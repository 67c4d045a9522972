import numpy as np

from retentia.llm import vocabulary
from retentia.llm.byte_bpe import decode, encode
from retentia.llm.packed import bundle, from_integers, from_planes, integers, planes, unbundle

SCHEMA = "doc_id long, text string, ids string, bucket int, block int, kind int, payload string"
TEXTS = [
    "The cat's tail, the   cat's\n\n tail\t ",
    "",
    None,
    "Größe élan ñandú 中文字 \U0001f600\U0001f600 123456",
    "<|endoftext|> is ordinary text",
    "a" * 30_000,
    " ".join(f"word{i % 90}" for i in range(40_000)),
    "   ",
    "\u2028\u00a0x\u0000y",
]


def test_ids_and_bytes_equal_the_library(spark):
    rows = [(i, t, "c", 1, 2, 3, "p") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "c", 1, 2, 3, "p"), (0, TEXTS[0], "c", 1, 2, 3, "p")]
    encoder = vocabulary.encoding(vocabulary.RANK_FILE).encode_ordinary
    want = sorted((str(i), encoder(t or ""), (t or "").encode()) for i, t, *_ in rows)
    for chars in (50, 100_000, 8_000_000):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
        one = encode(docs, block_chars=chars, with_decoded=chars == 50)
        got = (one if chars == 50 else decode(one)).collect()
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], SCHEMA))).collect() == []


def test_both_files_hold_the_same_ranks():
    assert vocabulary.ranks(vocabulary.JSON_FILE) == vocabulary.ranks(vocabulary.RANK_FILE)


def test_packed_arrays():
    for values in ([], [0], [1, 65_535], [3, 65_536, 2**32 - 1]):
        x = np.array(values, dtype=np.uint32)
        assert from_planes(planes(x)).tolist() == values and from_integers(integers(x)).tolist() == values
    assert unbundle(bundle(b"", b"ab", b"c")) == [b"", b"ab", b"c"]
