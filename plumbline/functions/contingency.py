"""Counts of value pairs for many pairs of columns, from dictionary codes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# executors get the functions themselves and need not have this package installed
register_pickle_by_value(sys.modules[__name__])

CELLS = "col1 string, col2 string, v1 string, v2 string, n long"
ROWS = 1 << 16  # rows that are coded together
OUT = 1 << 17  # cells that are returned together


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes (-1 for missing) and the texts they stand for."""
    coded = column.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy().astype(np.int64), coded.dictionary


def _cells(a: np.ndarray, b: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes a * width + b that occur, and how often."""
    both = (a >= 0) & (b >= 0)
    codes = a[both] * width + b[both]
    if size <= 4 * len(codes) + 64:
        counts = np.bincount(codes, minlength=1)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(codes, return_counts=True)


def count_pairs(batches: Iterator[pa.RecordBatch], names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """One row per pair and value pair of each run of ROWS rows; rows are never multiplied by pairs, and a pair that is
    wanted both ways is counted once."""
    place = {n: i for i, n in enumerate(names)}
    wanted: dict[tuple[str, str], list[bool]] = {}
    for a, b in pairs:
        swapped = place[a] > place[b]
        wanted.setdefault((b, a) if swapped else (a, b), []).append(swapped)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        coded = [_coded(c.chunk(0) if c.num_chunks else pa.array([], pa.string())) for c in table.columns]
        out: list[tuple] = []
        size = 0
        for (a, b), ways in wanted.items():
            (x, left), (y, right) = coded[place[a]], coded[place[b]]
            if not len(left) or not len(right):
                continue
            found, n = _cells(x, y, len(right), len(left) * len(right))
            for swapped in ways:
                out.append((a, b, left, right, found // len(right), found % len(right), n, swapped))
                size += len(found)
            if size >= OUT:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns: list[list[pa.Array]] = [[], [], [], [], []]
        for a, b, left, right, i, j, n, swapped in out:
            names_, values = (a, b), (left.take(pa.array(i)), right.take(pa.array(j)))
            if swapped:
                names_, values = names_[::-1], values[::-1]
            parts = (pa.repeat(names_[0], len(n)), pa.repeat(names_[1], len(n)), *values, pa.array(n, pa.int64()))
            for column, part in zip(columns, parts, strict=True):
                column.append(part)
        return pa.record_batch([pa.concat_arrays(c) for c in columns], ["col1", "col2", "v1", "v2", "n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from counted(held)
            held = []
    if held:
        yield from counted(held)
