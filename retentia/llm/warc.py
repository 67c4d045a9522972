"""WARC archives with a Zstandard dictionary.

A file is a skippable frame that holds the dictionary, then one frame per
record, each compressed by itself with that dictionary. The dictionary is
trained on the file's own records, of which each gives a share. Pages whose
payload an earlier page holds already become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, new_folder, written

#: Start of the skippable frame that holds a WARC file's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_REVISIT_BYTES = 100
#: A file is closed when its records pass this size before compression.
FILE_BYTES = 24_000_000
DICTIONARY_BYTES, SAMPLE_BYTES = 65_536, 2_000_000
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to, refers_url.

    Payload: the body in UTF-8, null counts as empty. Of equal payloads of at
    least LEAST_REVISIT_BYTES the one with the smallest id is the response and
    the others revisit it; a row without an id is one of the others, unless
    none has an id. Rows that repeat the response's id are responses too, as
    nothing tells them apart. An empty table gives an empty result; other
    columns are not looked at.
    """
    payload = F.encode(F.coalesce(F.col(f"`{body_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    first = written(
        rows.where(long_enough)
        .groupBy(F.unhex("digest").alias("key"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first"),
        )
        .where("n > 1")
        .select(F.lower(F.hex("key")).alias("digest"), F.lit(True).alias("shared"), "first"),
        "shared_payloads",
    )
    revisits = F.col("shared").isNotNull() & long_enough & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.join(broadcast_if_small(first), "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first.page_id")).alias("refers_to"),
        F.when(revisits, F.col("first.url")).alias("refers_url"),
    )


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page_id(uri: str) -> int | None:
    name = uri.removeprefix("urn:page:")
    return None if name == "none" else int(name)


def _target(url: str | None, page_id: int | None) -> str:
    """A header value: what may not stand in one is percent-encoded."""
    return urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else _uri(page_id)


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_url) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <{_uri(refers_to)}>",
            f"WARC-Refers-To-Target-URI: {_target(refers_url, refers_to)}",
        ]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]):
    """A dictionary from an equal share of every record; raw content where
    there is too little to train on."""
    import zstandard

    share = max(64, SAMPLE_BYTES // max(1, len(records)))
    samples = [r[:256] + r[256 + (len(r) * 7919 * i) % max(1, len(r) - share) :][:share] for i, r in enumerate(records)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    import zstandard

    dictionary = train_dictionary(records)
    dictionary.precompute_compress(level=LEVEL)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(compressor.compress, records)])


def write_archives(records: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of ``page_records`` into .warc.zst files of
    ``folder`` (default: a new one in the shared folder); the manifest, a
    stored table (path, records, bytes), lists those of finished tasks only."""
    spark = records.sparkSession
    folder = folder or new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def closed(found: list[bytes]) -> pa.RecordBatch:
            path, data = f"{base}/{uuid.uuid4().hex}.warc.zst", archive_bytes(found)
            with store.open_output_stream(path, compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"path": path.removeprefix(f"{base}/"), "records": len(found), "bytes": len(data)}])

        waiting: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                waiting.append(record_bytes(*(c[i].as_py() for c in batch.columns)))
                size += len(waiting[-1])
                if size >= file_bytes:
                    yield closed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield closed(waiting)

    columns = ["page_id", "url", "payload", "digest", "record_type", "refers_to", "refers_url"]
    files = records.select(*columns).mapInArrow(write, "path string, records long, bytes long")
    return written(files.withColumn("folder", F.lit(folder)), "warc_manifest")


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.zst file."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not start with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True)
    buffer = b""

    def more() -> bool:
        nonlocal buffer
        got = reader.read(1 << 20)
        buffer += got
        return bool(got)

    while buffer or more():
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's head is cut off")
        head = dict(line.split(": ", 1) for line in buffer[:end].decode().split("\r\n")[1:])
        need = end + 4 + int(head["Content-Length"]) + 4
        parts, have = [buffer], len(buffer)
        while have < need:
            got = reader.read(max(1 << 20, need - have))
            if not got:
                raise ValueError("a record's block is cut off")
            parts.append(got)
            have += len(got)
        buffer = b"".join(parts) if len(parts) > 1 else buffer
        yield head, buffer[end + 4 : need - 4]
        buffer = buffer[need:]


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and
    payload (null for revisits) of every record of the manifest's files.

    A response whose payload does not have the digest of its head is an
    error; size and digest of a revisit are those its head states."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for head, block in read_archive(stream):
                        rows.append(_parsed(head, block))
                        size += len(block)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("path", "folder")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def _parsed(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its head states")
    return {
        "page_id": _page_id(head["WARC-Record-ID"].strip("<>")),
        "url": head["WARC-Target-URI"],
        "record_type": head["WARC-Type"],
        "refers_to": _page_id(head["WARC-Refers-To"].strip("<>")) if revisit else None,
        "payload_bytes": stated,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }
