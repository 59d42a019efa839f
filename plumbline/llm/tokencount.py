"""Token counts by a two-tier map-side lookup.

A text is cut at places where the byte-level pre-tokenizer always cuts (before a lone space, around other white
space), so each chunk encodes to the same tokens alone as inside its text. Tier one is a broadcast table of the
lengths of the corpus's most frequent chunks; tier two is a bounded cache of each worker, filled by encoding the misses
with the tokenizer's own pre-tokenizer and model. No chunk is shuffled: the frequent ones are found by sketches of
fixed size, one for each of ``sketch_groups`` groups of tasks, over all documents.

Defined cases: a NULL text counts as empty and has no tokens; repeated rows are counted each; an empty table gives no
rows; special strings inside a text are one token each, as the library reads them; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WHITE, cut, slices, text_column

CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def _load(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    return Tokenizer.from_file(path), settings


class Lengths(dict):
    """Chunk -> number of tokens. The frequent chunks stay; the others are dropped together when there are too many."""

    def __init__(self, name: str, frequent: dict[str, int], limit: int):
        super().__init__(frequent)
        self.tokenizer, settings = _load(name)
        pre = settings["pre_tokenizer"] or {}
        self.splits = settings["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.model, self.cut, self.frequent, self.limit = self.tokenizer.model, self.tokenizer.pre_tokenizer, frequent, limit
        self.special = re.compile("|".join(re.escape(x["content"]) for x in settings["added_tokens"]) or r"(?!)")
        self.strings = [x["content"] for x in settings["added_tokens"]]
        self.pieces: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        total = 0
        for piece, _ in self.cut.pre_tokenize_str(chunk):
            n = self.pieces.get(piece)
            if n is None:
                n = len(self.model.tokenize(piece))
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                if len(piece) < 200:
                    self.pieces[piece] = n
            total += n
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        if len(chunk) < 200:
            self[chunk] = total
        return total

    def count(self, text: str) -> int:
        if not self.splits:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if any(s in text for s in self.strings):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, CHUNK.findall(p))) for p in parts)
        return sum(map(self.__getitem__, CHUNK.findall(text)))


_WORKER: dict[tuple, Lengths] = {}


def frequent_chunks(docs: DataFrame, top: int, tracked: int, sketch_groups: int) -> list[str]:
    """Spaced words that are frequent over all documents, by mergeable sketches."""
    words = docs.select(F.spark_partition_id().alias("task"), F.explode(F.split(text_column(docs), " ")).alias("word"))
    sketches = cut(words.groupBy(F.pmod("task", F.lit(sketch_groups)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(word, {tracked})").alias("sketch")), "sketches")
    if sketches.isEmpty():
        return []
    # At most ``sketch_groups`` rows; one task, as the combination fails on a task without rows.
    best = sketches.coalesce(1).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {top})").alias("best")).collect()[0]["best"]
    return [" " + x["item"] for x in best or [] if x["item"] and CHUNK.fullmatch(" " + x["item"])]


def token_counts(
    docs: DataFrame,
    *,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 512,
    top: int = 8192,
    tracked: int = 32768,
    cached: int = 400_000,
    sketch_groups: int = 64,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) for each row.

    ``top`` bounds the broadcast table, ``cached`` the chunks a worker remembers; neither changes a result.
    """
    spark = docs.sparkSession
    table = Lengths(vocabulary, {}, cached)
    table = spark.sparkContext.broadcast({c: table.count(c) for c in frequent_chunks(docs, top, tracked, sketch_groups)})

    def run(batches):
        key = (vocabulary, len(table.value), cached)
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Lengths(vocabulary, table.value, cached)
        lengths = _WORKER[key]
        for batch in slices(batches):
            counts = pa.array([lengths.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_column(docs)
    kept = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
