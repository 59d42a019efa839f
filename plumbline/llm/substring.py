"""Removal of repeated passages by fixed-block anchors.

A passage is ``window`` words. Any run of 13 words holds one whole block of 7 words that starts at a multiple of 7, so
the index holds only the non-overlapping blocks of every document, and every rolling window of 7 words is a probe. Blocks
and probes that meet outside their own place are anchors. Hits are extended to maximal exact repeats: every passage
around an anchor is a candidate, candidates meet their equals by a 96-bit hash, and the repeat of a document is the union
of its overlapping passages that also start in a document with a smaller doc_id.

The documents are written once, in buckets of chunks that no later step shuffles; only hashes move. A chunk sends each
hash once, sorted and packed, to the part that owns its range, and gets back the ones that matter, so a passage in a
third of all documents costs a part one entry per chunk. Parts grow in number with the text.

Defined cases: a NULL text has no words; documents of fewer words than a window keep all; a NULL doc_id is larger than any
other, and equal doc_ids are not smaller than each other, so repeated rows do not remove each other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, text_column
from plumbline.sources.scratch import scratch_path, scratch_table

LAST = np.iinfo(np.int64).max  # stands for a NULL doc_id
MESSAGE = "part long, chunk long, body binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane; sorted ones become small."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        key = np.full(n, 0x9E3779B97F4A7C15 ^ seed, dtype=np.uint64)
        for i in range(width):
            key = (key ^ hashes[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key


class Chunk:
    """The documents of a chunk as word hashes."""

    def __init__(self, table: pa.Table, window: int):
        from xxhash import xxh3_64_intdigest

        self.window, self.block = window, (window + 1) // 2
        self.ids = table["doc_id"].to_pylist()
        self.order = np.array([LAST if i is None else i for i in self.ids], dtype=np.int64)
        self.words = [t.as_py().encode().split() for t in table["text"]]
        self.hashes = [np.fromiter(map(xxh3_64_intdigest, w), dtype=np.uint64, count=len(w)) for w in self.words]
        self.long = [d for d, w in enumerate(self.words) if len(w) >= window]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (48 bits) of every rolling window of a block's width, and whether it is a block."""
        runs = [rolling(self.hashes[d], self.block) >> np.uint64(16) for d in self.long]
        starts = [np.arange(len(r)) % self.block == 0 for r in runs]
        return np.concatenate([np.empty(0, np.uint64), *runs]), np.concatenate([np.empty(0, bool), *starts])

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of every passage, its document's order and its document's place."""
        one = [rolling(self.hashes[d], self.window) for d in self.long]
        two = [rolling(self.hashes[d], self.window, 0x5851F42D4C957F2D) >> np.uint64(32) for d in self.long]
        sizes = [len(r) for r in one]
        place = np.repeat(np.array(self.long, dtype=np.int64), sizes)
        empty = np.empty(0, np.uint64)
        return np.concatenate([empty, *one]), np.concatenate([empty, *two]), self.order[place], place


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The chunks and bodies of a group's messages."""
    return table["chunk"].to_numpy(), table["body"].to_pylist()


def _send(part: np.ndarray, chunk: int, *columns: np.ndarray) -> pa.Table:
    """One message for each part; rows are sorted by part."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    bodies = [pack(*(c[a:b] for c in columns)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    owners = part[edges[:-1]].astype(np.int64) if len(part) else np.empty(0, np.int64)
    return pa.table({"part": pa.array(owners), "chunk": pa.array(np.full(len(bodies), chunk, dtype=np.int64)), "body": pa.array(bodies, pa.binary())})


def _owner(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part that owns a hash: equal ranges of its top 32 bits."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def ask_anchors(window: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, is_block = Chunk(table, window).anchors()
        order = np.argsort(hashes, kind="stable")
        hashes, is_block = hashes[order], is_block[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
        # A hash that repeats inside the chunk is known to the chunk; the others ask on its behalf too.
        block = np.maximum.reduceat(is_block, first) if len(first) else is_block
        hashes = hashes[first]
        six = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)
        return _send(_owner(hashes, 48, parts), table["chunk"][0].as_py(), six, block.astype(np.uint8))

    return run


def answer_anchors(table: pa.Table) -> pa.Table:
    """For each chunk its hashes that another chunk has too, where one of them is a block."""
    chunks, bodies = _distinct(table)
    opened = [unpack(b, "V6", "u1") for b in bodies]
    hashes = np.concatenate([_wide(h) for h, _ in opened])
    block = np.concatenate([b for _, b in opened])
    owner = np.repeat(np.arange(len(chunks)), [len(h) for h, _ in opened])
    order = np.argsort(hashes, kind="stable")
    hashes, block, owner = hashes[order], block[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate([first, [len(hashes)]]))
    met = (sizes > 1) & (np.maximum.reduceat(block, first) > 0) if len(first) else np.empty(0, bool)
    hit = np.repeat(met, sizes)
    return _reply(chunks, owner[hit], hashes[hit])


def _wide(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six.view(np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _reply(chunks: np.ndarray, owner: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    sent = _send(owner[order], 0, *(c[order] for c in columns))
    return pa.table({"chunk": pa.array(chunks[sent["part"].to_numpy()]), "body": sent["body"]})


def ask_passages(window: int, parts: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _send(np.empty(0, np.int64), 0)
        chunk = Chunk(table, window)
        hashes, _ = chunk.anchors()
        unique, times = np.unique(hashes, return_counts=True)
        known = np.unique(np.concatenate([unique[times > 1], *(unpack(b.as_py(), "u8")[0] for b in replies["body"])]))
        anchored = _among(hashes, known)
        one, two, order, _ = chunk.passages()
        # Passage s of a document holds the rolling windows s .. s + window - block.
        candidate, at, reach = [], 0, window - chunk.block + 1
        for d in chunk.long:
            n = len(chunk.hashes[d])
            sums = np.concatenate([[0], np.cumsum(anchored[at : at + n - chunk.block + 1])])
            candidate.append(sums[reach:] - sums[:-reach] > 0)
            at += n - chunk.block + 1
        picked = np.flatnonzero(np.concatenate([np.empty(0, bool), *candidate]))
        one, two, order = one[picked], two[picked], order[picked]
        sort = np.lexsort((order, two, one))
        one, two, order = one[sort], two[sort], order[sort]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.empty(0, np.int64)
        one, two, order = one[first], two[first], order[first]
        return _send(_owner(one, 64, parts), table["chunk"][0].as_py(), one, two.astype(np.uint32), order)

    return run


def answer_passages(table: pa.Table) -> pa.Table:
    """For each chunk its passages that another chunk has in a document with a smaller doc_id."""
    chunks, bodies = _distinct(table)
    opened = [unpack(b, "u8", "u4", "i8") for b in bodies]
    one, two, order = (np.concatenate([o[i] for o in opened]) for i in range(3))
    owner = np.repeat(np.arange(len(chunks)), [len(o[0]) for o in opened])
    sort = np.lexsort((order, two, one))
    one, two, order, owner = one[sort], two[sort], order[sort], owner[sort]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.empty(0, np.int64)
    least = np.repeat(order[first], np.diff(np.concatenate([first, [len(one)]])))
    hit = order > least
    return _reply(chunks, owner[hit], one[hit], two[hit])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    pair = np.empty(len(one), dtype=[("one", "u8"), ("two", "u8")])
    pair["one"], pair["two"] = one, two
    return pair


def cover(window: int, texts: bool):
    """The documents of a chunk with their repeated words removed."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        chunk = Chunk(table, window)
        one, two, order, place = chunk.passages()
        opened = [unpack(b.as_py(), "u8", "u4") for b in replies["body"]]
        outside = np.unique(_mixed(np.concatenate([np.empty(0, np.uint64), *(o[0] for o in opened)]), np.concatenate([np.empty(0, np.uint64), *(o[1].astype(np.uint64) for o in opened)])))
        sort = np.lexsort((order, two, one))
        a, b = one[sort], two[sort]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        gone = np.zeros(len(one), dtype=bool)
        gone[sort] = order[sort] > np.repeat(order[sort][first], np.diff(np.concatenate([first, [len(a)]])))
        if len(outside):
            keys = np.searchsorted(outside["one"], one)
            maybe = np.flatnonzero(outside["one"][np.minimum(keys, len(outside) - 1)] == one)
            gone[maybe] |= np.isin(_mixed(one[maybe], two[maybe]), outside)
        rows, at = [], 0
        for d, words in enumerate(chunk.words):
            n, removed = len(words), 0
            if n >= window:
                starts = np.flatnonzero(gone[at : at + n - window + 1])
                at += n - window + 1
                if len(starts):
                    edges = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + window, -1)
                    keep = np.cumsum(edges)[:-1] == 0
                    removed = n - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
            kept = b" ".join(words)
            rows.append((chunk.ids[d], n, removed, kept.decode() if texts else hashlib.sha256(kept).hexdigest()))
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    names = ["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return run


def remove_repeats(docs: DataFrame, *, window: int = 13, chunks_each: int = 8, part_words: int = 2_000_000, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or, with ``texts``, kept: the kept words joined by spaces).

    ``chunks_each`` chunks are made of each input partition; a part gets about ``part_words`` hashes.
    """
    spark = docs.sparkSession
    buckets = max(1, docs.rdd.getNumPartitions())
    text = text_column(docs)
    chunk = F.spark_partition_id().cast("long") * chunks_each + F.pmod(F.xxhash64("doc_id", text), F.lit(chunks_each))
    name = scratch_table(spark, "chunks")
    written = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), chunk.alias("chunk"))
    written.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).saveAsTable(name)
    table = spark.table(name)
    size = table.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = max(1, round(size / 6 / part_words))

    asked = table.groupBy("chunk").applyInArrow(ask_anchors(window, parts), MESSAGE)
    anchors = cut(asked.groupBy("part").applyInArrow(answer_anchors, "chunk long, body binary"), "anchors")
    both = lambda right, run, schema: table.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)
    candidates = both(anchors, ask_passages(window, parts), MESSAGE)
    repeats = cut(candidates.groupBy("part").applyInArrow(answer_passages, "chunk long, body binary"), "repeats")
    return both(repeats, cover(window, texts), f"doc_id long, n_words long, n_removed long, {'kept' if texts else 'kept_sha256'} string")
