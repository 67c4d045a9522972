import hashlib
import io

import pytest
import zstandard

from retentia.llm.warc import DICTIONARY_FRAME, archive_bytes, page_records, read_archive, read_archives, record_bytes, write_archives

SCHEMA = "page_id long, url string, html string, digest string, payload string, first int, n int, shared string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "p", 1, 2, "s") for i, u, h in rows], SCHEMA)


BIG = "<p>élan</p>" * 20
ROWS = (
    [(i, f"http://h/{i}", f"<html>{i} " + "body " * 40) for i in range(5, 40)]
    + [(90, "http://h/x", BIG), (50, "http://h/y", BIG), (70, None, BIG), (None, "http://h/z", BIG)]
    + [(1, "a b\r\nEvil: 1", "short"), (2, "\u00fc", "short"), (3, None, None), (4, "", "")]
    + [(200, "long", "z" * 3_000_000), (201, "head", "x\r\n\r\nWARC/1.1\r\n\r\n" * 30)]
    + [(300, "r", BIG + "!"), (300, "r", BIG + "!"), (None, "q", "only " * 50), (None, "q", "only " * 50)]
)


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        first = min(known) if known else None
        revisit = len(data) >= 100 and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    manifest = write_archives(page_records(pages(spark, ROWS)), f"file://{tmp_path}/warc", file_bytes=20_000)
    got = read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    assert manifest.count() > 3
    bodies = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(bodies[200]) == b"z" * 3_000_000 and bytes(bodies[50]).decode() == BIG and bytes(bodies[3]) == b""
    assert {r.url for r in got if r.page_id == 1} == {"a%20b%0D%0AEvil:%201"}


def test_empty_table(spark):
    assert read_archives(write_archives(page_records(pages(spark, [])))).collect() == []


def test_records_are_frames_behind_a_dictionary():
    records = [record_bytes(i, f"u{i}", f"page {i} ".encode() * 30, "0" * 64, "response", None, None) for i in range(200)]
    data = archive_bytes(records)
    assert int.from_bytes(data[:4], "little") == DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, found = data[8 + size :], []
    while rest:
        one = decompress.decompressobj()
        found.append(one.decompress(rest))
        rest = one.unused_data
    assert found == records
    assert [h["WARC-Record-ID"] for h, _ in read_archive(io.BytesIO(data))] == [f"<urn:page:{i}>" for i in range(200)]
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(data[: len(data) - 9] if len(data) < 9 else b"\0" * 8)))
