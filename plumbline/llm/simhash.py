"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree in one segment, and differ there by at most two bits in the next one (pigeonhole). Each segment is decoded by the
perfect [23,12,7] Golay code: a word within two bits of its codeword gets that codeword's index as its only key, a word
at three bits also gets the five codewords at four bits. Any two words that differ in at most two bits then share an
index, so (exact segment, index of the next segment) gives a fingerprint up to 18 keys of 34 bits, on which candidates
join and are verified by bit count.

Keys hold distinct fingerprints, so copies meet before. A key with more than ``bucket`` of them (a group of near copies)
is not joined with itself: its members go by all 65 words within one bit of them instead. Fingerprints within two bits
share such a word, at most 65 distinct ones can share it, and all that share it are within two bits of each other, so
a star per word keeps every link without pairs.

Defined cases: a NULL text is empty; a text without words has fingerprint zero and links like any other; repeated rows
and equal doc_ids are rows of their own; a NULL doc_id is never a component's id unless all of its are NULL; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import CHUNK, ROW, cut, in_chunks, per_chunk, row_places, slices, text_column, trimmed
from plumbline.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # of the cyclic [23,12,7] code


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def _patterns() -> np.ndarray:
    """For each syndrome the errors that lead to a key: one of weight up to two, or one of weight three and five of
    weight four; -1 where there are fewer."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for error, s in zip(errors.tolist(), _syndrome(errors).tolist(), strict=True):
            if weight < 4 or table[s, 0].bit_count() == 3:
                table[s, used[s]] = error
                used[s] += 1
    return table


_TABLE: list[np.ndarray] = []


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``prints``, key) of every key of the uint64 fingerprints."""
    if not _TABLE:
        _TABLE.append(_patterns())
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    places, keys = [], []
    for i in range(3):
        word = parts[(i + 1) % 3]
        errors = _TABLE[0][_syndrome(word)]
        place, column = np.nonzero(errors >= 0)
        index = (word[place] ^ errors[place, column]) >> 11
        places.append(place)
        keys.append(np.int64(i) << 34 | parts[i][place] << 12 | index)
    return np.concatenate(places), np.concatenate(keys)


def fingerprint(text: str, words_each: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII white-space characters split
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words_each, len(words))
    n, ones = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        till = min(n, at + (1 << 16))
        cuts = zip(starts[at:till].tolist(), ends[at + width - 1 : till + width - 1].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in cuts], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_each: int = 3, keep: tuple[str, ...] = ("doc_id",), out: str = "fp") -> DataFrame:
    """The columns to keep, and the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words_each) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=names)

    names = [*keep, out]
    schema = docs.select(*keep).withColumn(out, F.lit(0).cast("long")).schema
    return docs.select(*keep, text_column(docs).alias("__text")).mapInArrow(trimmed(run), schema)


def _keyed(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        place, key = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(fp[place]), pa.array(key)], names=["fp", "key"])


def _flipped(batches):
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        word = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, 65)), pa.array(word.reshape(-1))], names=["fp", "word"])


def links(prints: DataFrame, bucket: int = 128) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all those within two bits of each other.

    A link of a crowded key is a step of its star; every link is at most two bits long.
    """
    keys = cut(prints.mapInArrow(_keyed, "fp long, key long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(keys.join(cut(sizes, "golay-sizes"), "key"), "golay-met")
    few = met.filter(F.col("n") <= bucket)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    crowd = met.filter(F.col("n") > bucket).select("fp").distinct()
    near = crowd.mapInArrow(_flipped, "fp long, word long").groupBy("word").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    stars = near.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def _labels(hashed: DataFrame, bucket: int) -> DataFrame:
    """(fp, label): the smallest fingerprint reachable, as a signed long."""
    prints = cut(hashed.select("fp").distinct(), "simhash-prints")
    found = components(links(prints, bucket))
    return prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("label"))


def near_duplicates(docs: DataFrame, *, words_each: int = 3, bucket: int = 128) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row."""
    hashed = cut(fingerprints(docs, words_each), "simhash")
    labels = cut(_labels(hashed, bucket), "simhash-labels")
    # The smallest doc_id: per fingerprint first, then per component; both combine before the shuffle.
    each = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first").join(labels, "fp")
    each = cut(each, "simhash-each")
    lowest = cut(each.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-lowest")
    of = cut(each.select("fp", "label").join(lowest, "label").select("fp", "component_id"), "simhash-of")
    return hashed.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, words_each: int = 3, bucket: int = 128) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (of equal ones, the smallest fingerprint).

    Documents are written once and not shuffled: the numbers of the rows that stay go to them.
    """
    mark = "__fp"
    if taken := {mark, CHUNK, ROW} & set(docs.columns):
        raise ValueError(f"reserved column names: {sorted(taken)}")
    table = in_chunks(fingerprints(docs, words_each, tuple(docs.columns), mark), "dedup-docs")
    hashed = table.select("doc_id", mark, CHUNK, ROW)
    labels = cut(_labels(hashed.select(F.col(mark).alias("fp")), bucket), "dedup-labels")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", mark, ROW, CHUNK)).alias("first")
    each = cut(hashed.groupBy(mark).agg(first), "dedup-first").join(labels, F.col(mark) == labels["fp"])
    best = each.groupBy("label").agg(F.min("first").alias("best")).select(F.col(f"best.{CHUNK}").alias(CHUNK), F.col(f"best.{ROW}").alias(ROW))
    names = list(docs.columns)

    def stay(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        return rows.take(np.sort(row_places(rows, wanted))).select(names)

    return per_chunk(table, cut(best, "dedup-best"), stay, docs.schema)
