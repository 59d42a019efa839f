"""Mixing sources to target weights.

The words of each source are packed end to end into fixed-length blocks. Every output shard draws multinomial block
counts over the sources, the draws of a source map through a pseudorandom permutation of its block numbers (a new one
for each pass over the source), and slots join blocks by (source, block number).

Defined cases: a NULL text has no words; a NULL source is a source of its own, after all others; a NULL doc_id sorts
first; repeated rows are documents of their own; an empty table, or one without words, gives no slots; other columns
are ignored. Only fully identical rows are ordered arbitrarily, and they are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import CHUNK, ROW, WORD_RE, cut, in_chunks, n_words, per_chunk, row_places, shuffle_partitions, text_column


@dataclass
class Mix:
    """``documents``: row, doc_id, source, source_no, size, print (a hash of the text). ``sources``: source_no, source, size, target (a bounded
    table, one row per source). ``pieces``: shard, position, copy, source_no, block, row, doc_id, start, words - the
    mixed output, ``words`` words of the document from word ``start`` on, in order of (shard, position, place)."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def targets(sizes: list[int], weights: list[float], share: float = 1.0, cap: float = 3.0) -> list[float]:
    """``share`` of all sizes dealt by weight; nothing gets more than ``cap`` times its size, and what is above goes
    to the others by weight until none is above."""
    left, out = float(sum(sizes)) * share, [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0]
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if rate * weights[i] >= cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else rate * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places ``x``: four Feistel rounds over the next even power of two,
    walked along the cycle until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        a, b = v >> np.uint64(half), v & mask
        for r in range(4):
            f = b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f ^ (f >> np.uint64(31))) & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        out = once(x.astype(np.uint64))
        while (far := out >= n).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


EXACT = 10**9  # slots up to which numpy draws exactly


def _split(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among ``take`` slots drawn from ``left`` without putting back. Beyond EXACT slots the
    counts are drawn from the normal distribution with the same mean and spread, then made to add up."""
    total = int(left.sum())
    if total < EXACT:
        return rng.multivariate_hypergeometric(left, take, method="marginals")
    share = take / total
    near = rng.normal(left * share, np.sqrt(left * share * (1 - share)))
    near += (take - near.sum()) * left / total  # what draws that add up have: independent ones less their common error
    part = np.clip(np.rint(near).astype(np.int64), 0, left)
    while off := take - int(part.sum()):
        room = left - part if off > 0 else part
        order = np.argsort(-room, kind="stable")
        upto = np.minimum(np.cumsum(room[order]), abs(off))
        part[order] += np.sign(off) * np.diff(upto, prepend=0)
    return part


def draw(quotas: np.ndarray, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one output shard, and in all shards before it.

    The quotas are split in two halves of the shards, these in halves again, down to the shard: multinomial counts, given
    that the shards together meet the quotas exactly. Every task finds its shards' counts by itself, from the quotas.
    """
    left, first = np.array(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64)
    low, high = 0, -(-int(left.sum()) // shard_slots)
    while high - low > 1:
        middle = (low + high) // 2
        part = _split(left, (middle - low) * shard_slots, np.random.Generator(np.random.Philox([seed, (low << 32) + high])))
        if shard < middle:
            left, high = part, middle
        else:
            left, first, low = left - part, first + part, middle
    return left, first


def shard_counts(quotas: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """``draw`` for every shard."""
    shards = -(-sum(quotas) // shard_slots)
    return np.array([draw(np.array(quotas), shard_slots, s, seed)[0] for s in range(shards)], dtype=np.int64).reshape(shards, len(quotas))


def _slots(quotas: list[int], blocks: list[int], shard_slots: int, seed: int, step: int = 1 << 16):
    """The slots of the shards that a task gets: (shard, position, copy, source_no, block)."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, first = draw(np.array(quotas), shard_slots, shard, seed)
                slots, before = int(counts.sum()), np.cumsum(counts) - counts
                for source in np.flatnonzero(counts).tolist():
                    for at in range(0, int(counts[source]), step):
                        k = np.arange(at, min(int(counts[source]), at + step), dtype=np.int64)
                        copy, place = np.divmod(first[source] + k, blocks[source])
                        block = np.empty_like(place)
                        for c in np.unique(copy):
                            block[copy == c] = permute(place[copy == c], blocks[source], seed + 1000003 * source + int(c))
                        position = permute(before[source] + k, slots, seed + 7919 * shard)
                        columns = (np.full(len(k), shard, dtype=np.int64), position, copy, np.full(len(k), source, dtype=np.int64), block)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "position", "copy", "source_no", "block"])

    return run


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    cap: float = 3.0,
    block_words: int = 128,
    shard_slots: int = 1 << 16,
    stream_docs: int = 1000,
    max_sources: int = 1 << 16,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> Mix:
    """Mix the documents' words by source. ``weights`` repeat over the sources in code-point order, NULL last.

    A source is packed in streams of about ``stream_docs`` documents, so that a source with a third of all rows is
    many small sorts; only a stream's last block is short. Columns to ``carry`` go to the documents of the result. The table of sources is a setting of the mixture and goes
    through the driver: more than ``max_sources`` raise.
    """
    spark = docs.sparkSession
    text = text_column(docs)
    sized = cut(docs.select("doc_id", docs["source"].cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("print"), *carry), "mix-sizes")
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
    sources = spark.createDataFrame(
        [(i, r["source"], r["size"], t, -(-r["n"] // stream_docs)) for i, (r, t) in enumerate(zip(found, aims, strict=True))],
        "source_no long, source string, source_size long, target double, streams long",
    )

    # Streams: a hash of the row's content deals them, the order inside one is by doc_id.
    dealt = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).select(
        "doc_id", sized["source"], "source_no", "size", "print", F.pmod(F.xxhash64("doc_id", "print"), F.col("streams")).alias("stream"), *carry
    )
    one = Window.partitionBy("source_no", "stream").orderBy("doc_id", "print", *carry)
    rows = cut(
        dealt.withColumn("n", F.row_number().over(one)).withColumn("end", F.sum("size").over(one.rowsBetween(Window.unboundedPreceding, 0))),
        "mix-rows",
    )
    streams = rows.groupBy("source_no", "stream").agg(F.ceil(F.max("end") / block_words).alias("blocks"))
    # A source's streams are numbered in runs of 4096, so that no task holds all of a source.
    streams = cut(streams.withColumn("run", F.floor(F.col("stream") / 4096)), "mix-streams")
    runs = streams.groupBy("source_no", "run").agg(F.sum("blocks").alias("m"))
    runs = runs.select("source_no", "run", (F.sum("m").over(Window.partitionBy("source_no").orderBy("run")) - F.col("m")).alias("earlier"))
    inside = F.sum("blocks").over(Window.partitionBy("source_no", "run").orderBy("stream")) - F.col("blocks")
    streams = streams.join(runs, ["source_no", "run"]).withColumn("first", F.col("earlier") + inside).drop("run", "earlier")
    of = {r["source_no"]: r["blocks"] for r in streams.groupBy("source_no").agg(F.sum("blocks").alias("blocks")).collect()}

    key = F.concat_ws("-", "source_no", "stream", "n")
    documents = rows.select(key.alias("row"), "doc_id", "source", "source_no", "size", "print", *carry)
    placed = rows.filter("size > 0").join(streams.select("source_no", "stream", "first"), ["source_no", "stream"])
    place = F.explode(F.sequence(F.floor((F.col("end") - F.col("size")) / block_words), F.floor((F.col("end") - 1) / block_words)))
    start = F.col("end") - F.col("size")
    low, high = F.greatest(start, F.col("at") * block_words), F.least(F.col("end"), (F.col("at") + 1) * block_words)
    held = placed.select("*", place.alias("at")).select(
        "source_no", (F.col("first") + F.col("at")).alias("block"), key.alias("row"), "doc_id", (low - start).alias("start"), (high - low).alias("words"), (low % block_words).alias("place")
    )

    quotas = [min(round(t / r["size"] * of[i]), int(cap * of[i])) if of.get(i) else 0 for i, (r, t) in enumerate(zip(found, aims, strict=True))]
    blocks = [int(of.get(i, 0)) for i in range(len(found))]
    shards = -(-sum(quotas) // shard_slots)
    drawn = (
        spark.range(0, shards, 1, max(1, min(shards, 4 * shuffle_partitions(spark))))
        .repartition(shuffle_partitions(spark))
        .mapInArrow(_slots(quotas, blocks, shard_slots, seed), "shard long, position long, copy long, source_no long, block long")
    )
    # The slots come out of few rows, so their estimated size must not make them a broadcast.
    pieces = drawn.hint("merge").join(held, ["source_no", "block"]).select("shard", "position", "copy", "source_no", "block", "place", "row", "doc_id", "start", "words")
    return Mix(documents, sources.drop("streams"), pieces)


def taken(mixed: Mix) -> DataFrame:
    """Each document with its source's size and target and the words the mix takes of it, repeats counted."""
    words = mixed.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    out = mixed.documents.join(words, "row", "left").join(F.broadcast(mixed.sources.drop("source")), "source_no")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def cut_text(text: str, starts: list[int], lengths: list[int]) -> str:
    """The runs of words (in order) of a text; what lies between the words of a run stays, runs are put on lines."""
    spans = [m.span() for m in WORD_RE.finditer(text)]
    if sum(lengths) == len(spans):
        return text
    runs: list[list[int]] = []
    for start, n in zip(starts, lengths, strict=True):
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + n
        else:
            runs.append([start, start + n])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for every pass of the mix over a document, with the words taken in that pass.

    The columns are those of the input; n_chars, where there is one, follows the text. Documents are written once and
    not shuffled: what the mix takes of a row goes to it. Repeated rows are documents of their own.
    """
    table = in_chunks(docs, "mix-docs")
    mixed = mix(table, carry=(CHUNK, ROW), **options)
    order = F.sort_array(F.collect_list(F.struct("start", "words")))  # the blocks of one document
    runs = mixed.pieces.groupBy("row", "copy").agg(order.alias("runs")).join(mixed.documents.select("row", CHUNK, ROW), "row")
    wanted = runs.select(CHUNK, ROW, "copy", F.col("runs.start").alias("starts"), F.col("runs.words").alias("lengths"))
    names, size = list(docs.columns), "n_chars" if "n_chars" in docs.columns else None

    def pick(rows: pa.Table, taken: pa.Table) -> pa.Table:
        taken = taken.sort_by([(ROW, "ascending"), ("copy", "ascending")])
        out = rows.take(row_places(rows, taken)).select(names)
        texts = [cut_text(*x) for x in zip(out["text"].cast(pa.string()).to_pylist(), taken["starts"].to_pylist(), taken["lengths"].to_pylist(), strict=True)]
        new = {"text": pa.array(texts, pa.string())} | ({size: pa.array([len(t) for t in texts], pa.int64())} if size else {})
        for name, column in new.items():
            out = out.set_column(names.index(name), name, column.cast(rows.schema.field(name).type))
        return out

    return per_chunk(table, wanted, pick, docs.schema)
