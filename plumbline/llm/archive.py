"""WARC archives in seekable Zstandard bundles.

Each task writes its records to bundle files: runs of records become independent frames of about ``frame_bytes``, and a
footer seek table (a skippable frame, so that any zstd reader can still read the file) lists the frames' sizes. The
index that ``write`` returns maps a record to (path, frame, offset inside the frame), so one record is read by
decompressing one frame.

A payload is stored once: of records with equal payloads the one with the smallest page_id is a response, the others
are revisits that refer to it.

Defined cases: a NULL html is an empty payload; a NULL url becomes urn:page:<id>; a NULL page_id is never the smallest
unless all of its payload are NULL; rows that repeat the smallest page_id are all responses; an empty table gives an
empty index; other columns are ignored. Files carry the attempt's number: a lost attempt leaves a file to which no
index row points.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shuffle_partitions
from plumbline.sources.scratch import scratch_path

# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, path string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> tuple[str, bytes]:
    """The record's id and bytes; ``first`` is the page_id of the response that holds the payload."""
    kind = "response" if page_id == first else "revisit"
    name = lambda x: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {x}')}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + (f"urn:page:{page_id}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(first)}>", f"X-Refers-To-Page: {first}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return name(page_id), "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at the offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    length = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    inner = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:inner].decode().split("\r\n")[1:])
    out = {
        "record_id": head["WARC-Record-ID"][1:-1],
        "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None,
        "url": None if head["WARC-Target-URI"].startswith("urn:page:") else head["WARC-Target-URI"],
        "record_type": head["WARC-Type"],
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
        "payload": block[inner + 4 :] if head["WARC-Type"] == "response" else None,
    }
    return out, end + 4 + length + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, decompressed) sizes of the frames."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the end of an open file."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def write(pages: DataFrame, *, min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row (page_id, url, html) and return the index, one row per record."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    plain = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("same"), F.sha1(payload).alias("digest"))
    # Only payloads that occur twice are joined, and only ids and digests are grouped.
    shared = plain.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = plain.join(cut(shared, "warc-shared"), "same", "left").drop("same")

    def run(batches):
        context = TaskContext.get()
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        state = {"file": None, "n": 0}

        def flush():
            if state["held"]:
                data = b"".join(state["held"])
                packed = packer.compress(data)
                state["file"].write(packed)
                state["sizes"].append((len(packed), len(data)))
                state["bytes"] += len(packed)
                state["held"], state["plain"] = [], 0

        def close():
            if state["file"] is not None:
                flush()
                state["file"].write(seek_table(state["sizes"]))
                state["file"].close()
                state["file"] = None

        for batch in batches:
            index = []
            for at in range(batch.num_rows):
                page_id, url, data, digest, first = (batch.column(i)[at].as_py() for i in range(5))
                name, raw = record(page_id, url, data, base64.b32encode(bytes.fromhex(digest)).decode(), page_id if first is None else first, date)
                if state["file"] is None:
                    file_name = f"{context.partitionId():06d}-{context.taskAttemptId():08d}-{state['n']:05d}.warc.zst"
                    state |= {"file": files.open_output_stream(f"{base}/{file_name}", compression=None), "path": f"{folder}/{file_name}", "sizes": [], "held": [], "plain": 0, "bytes": 0, "n": state["n"] + 1}
                index.append((name, page_id, state["path"], len(state["sizes"]), state["plain"], len(raw)))
                state["held"].append(raw)
                state["plain"] += len(raw)
                if state["plain"] >= frame_bytes:
                    flush()
                if state["bytes"] >= bundle_bytes:
                    close()
            columns = list(zip(*index, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["record_id", "page_id", "path", "frame", "offset", "length"])
        close()

    rows = rows.select("page_id", "url", "payload", "digest", "first")
    return cut(rows.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, *, payloads: bool = False, frames_each: int = 64) -> DataFrame:
    """Every record of the index, read at its place in the archives and checked against its digest.

    A task reads ranges of ``frames_each`` frames, so a large bundle is many tasks' work; each frame is decompressed once.
    """
    places = F.array_sort(F.collect_list(F.struct("frame", "offset", "record_id")))  # of one range
    asked = index.groupBy("path", F.floor(F.col("frame") / frames_each).alias("part")).agg(places.alias("places"))
    # A number that is asked for is kept: adaptive execution would put these short rows into one task.
    asked = asked.repartition(4 * shuffle_partitions(index.sparkSession), "path", "part").select("path", "places")

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = _files(uri)
                with files.open_input_file(path) as file:
                    table = read_seek_table(file)
                    for frame, own in groupby(wanted, lambda p: p["frame"]):
                        start, packed, plain = table[frame]
                        file.seek(start)
                        data, found = unpacker.decompress(file.read(packed), max_output_size=plain), []
                        for place in own:
                            one, _ = parse(data, place["offset"])
                            if one["record_id"] != place["record_id"]:
                                raise ValueError(f"{uri}: {place['record_id']} is not at its place")
                            if one["payload"] is not None and base64.b32encode(hashlib.sha1(one["payload"]).digest()).decode() != one["payload_digest"]:
                                raise ValueError(f"{uri}: {one['record_id']} does not match its digest")
                            if not payloads:
                                one["payload"] = None
                            found.append(one)
                        yield pa.RecordBatch.from_pylist(found, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))
    return asked.mapInArrow(run, RECORDS)


def fetch(uri: str, frame: int, offset: int) -> dict:
    """One record by its place: one frame is decompressed."""
    files, path = _files(uri)
    with files.open_input_file(path) as file:
        start, packed, plain = read_seek_table(file)[frame]
        file.seek(start)
        return parse(zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain), offset)[0]
