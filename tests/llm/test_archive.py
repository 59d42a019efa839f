import base64
import hashlib
import io
from collections import Counter

import pytest
import zstandard

from plumbline.llm import archive

SCHEMA = "page_id long, url string, html string, path string, frame int, digest string, first long"
PAGES = [
    (5, "http://a/ü b\r\nX-Page-ID: 9", "same é"), (3, "http://a", "same é"), (9, None, "same é"), (4, "http://b", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://c", None), (7, "", ""), (8, "http://d", "y" * 300_000), (2, "http://e", "z" * 300_000 + "\x00"), (None, "http://f", "same é"), (None, None, "lonely"),
    (10, "http://g", "twice"), (10, "http://g", "twice"),
]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "p", 1, "d", 7) for p in pages], SCHEMA)


def expected(pages, least=0):
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None]
        first = min(same, default=None)
        response = len(data) < least or page_id == first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"frame_bytes": 1, "bundle_bytes": 1}, {"min_revisit_bytes": 6}])
def test_read_back(spark, options):
    index = archive.write(frame(spark, PAGES), **options)
    got = archive.read(index).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in got) == expected(PAGES, options.get("min_revisit_bytes", 0))
    full = archive.read(index, payloads=True).collect()
    assert all(bytes(r["payload"]).decode() == dict((p[0], p[2] or "") for p in PAGES)[r["page_id"]] for r in full if r["record_type"] == "response" and r["page_id"] is not None)


def test_index_finds_each_record(spark):
    for row in archive.write(frame(spark, PAGES), frame_bytes=400).collect():
        one = archive.fetch(row["path"], row["frame"], row["offset"])
        assert (one["record_id"], one["page_id"]) == (row["record_id"], row["page_id"])


def test_bundles_are_plain_zstandard(spark):
    """A reader that knows nothing of the seek table reads all frames."""
    paths = {r["path"] for r in archive.write(frame(spark, PAGES), frame_bytes=400).collect()}
    found = 0
    for path in paths:
        files, base = archive._files(path)
        with files.open_input_file(base) as file:
            data = file.read()
            sizes = archive.read_seek_table(file)
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == sum(s[2] for s in sizes)
        at = 0
        while at < len(plain):
            _, at = archive.parse(plain, at)
            found += 1
    assert found == len(PAGES)


def test_empty(spark):
    index = archive.write(frame(spark, []))
    assert index.collect() == [] and archive.read(index).collect() == []


def test_reading_is_spread_and_uses_the_index(spark):
    index = archive.write(frame(spark, PAGES), frame_bytes=1)
    plan = archive.read(index)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    one = index.filter("page_id = 8")
    assert [r["page_id"] for r in archive.read(one).collect()] == [8]
    wrong = index.withColumn("record_id", index.path)
    with pytest.raises(Exception, match="is not at its place"):
        archive.read(wrong).collect()
    assert Counter(r["record_id"] for r in archive.read(index, frames_each=1).collect()) == Counter(r["record_id"] for r in index.collect())
