"""What several operators share: the word pattern, written tables, text batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch_path, scratch_table

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
# The Unicode White_Space characters, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def text_column(df: DataFrame, name: str = "text"):
    """The whole text; NULL reads as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def n_words(text):
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cut(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: a lost executor costs no recomputation and the
    rows are the same for every reader."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


CHUNK, ROW = "__chunk", "__row"


def in_chunks(df: DataFrame, label: str, chunks_each: int = 8) -> DataFrame:
    """The rows, written once with a chunk and a row number, in a table bucketed by chunk: ``per_chunk`` brings rows of
    other tables to a chunk's task without moving these. A task's rows make ``chunks_each`` chunks."""
    if taken := {CHUNK, ROW} & set(df.columns):
        raise ValueError(f"reserved column names: {sorted(taken)}")
    spark, name = df.sparkSession, scratch_table(df.sparkSession, "chunks")
    row = F.monotonically_increasing_id()
    chunk = F.shiftright(row, 33) * chunks_each + row % chunks_each  # the upper bits hold the partition
    numbered = df.withColumn(ROW, row).withColumn(CHUNK, chunk)
    buckets = max(1, df.rdd.getNumPartitions())
    numbered.write.bucketBy(buckets, CHUNK).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def per_chunk(table: DataFrame, other: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``run`` over each chunk's rows and the rows of ``other`` that name it."""
    return table.groupBy(CHUNK).cogroup(other.groupBy(CHUNK)).applyInArrow(run, schema)


def row_places(table: pa.Table, wanted: pa.Table) -> np.ndarray:
    """Where the rows that ``wanted`` names are in a chunk."""
    numbers = table[ROW].to_numpy()
    order = np.argsort(numbers)
    return order[np.searchsorted(numbers[order], wanted[ROW].to_numpy())]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run``, after which a worker hands its free memory back: workers live on, and what one stage has freed would
    else stay with them beside what the next one needs."""

    def tidied(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small views of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
