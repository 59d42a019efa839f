"""Counts, means and sums of products for all pairs of columns, as a buffer that tasks fill and merge."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# executors get the class itself and need not have this package installed
register_pickle_by_value(sys.modules[__name__])


class CoMoments:
    """Counts, means and sums of products of all column pairs over their complete rows; buffers merge."""

    SHAPE = "start array<double>, n array<double>, mean array<double>, squares array<double>, products array<double>"

    def __init__(self, width: int):
        self.n, self.mean, self.squares, self.products = (np.zeros((width, width)) for _ in range(4))
        # [i, j]: of column i over the rows where column j is present too; means are kept from one of the column's
        # values on, so that a small spread far from 0 is not lost
        self.start = np.zeros(width)

    def add(self, values: np.ndarray) -> None:
        """Rows; NaN is missing."""
        present = ~np.isnan(values)
        endless = np.isinf(values)
        start = np.array([c[p][0] if p.any() else 0.0 for c, p in zip(values.T, (present & ~endless).T, strict=True)])
        x = np.where(present & ~endless, values - start, 0.0)
        there = present.astype(np.float64)
        n = there.T @ there
        some = np.maximum(n, 1)
        total = x.T @ there
        raw = (x**2).T @ there
        mean = total / some
        squares = raw - total * mean
        products = x.T @ x - total * mean.T
        # Where next to nothing is left of the squares, rounding decides: these pairs are summed about their own mean.
        for i, j in np.argwhere((n > 0) & (squares <= 1e-6 * raw) & (raw > 0)):
            both = present[:, i] & present[:, j]
            own, other = x[both, i], x[both, j]
            off = own - own[0]
            mean[i, j] = own[0] + off.mean()
            off -= off.mean()
            squares[i, j] = (off**2).sum()
            products[i, j] = products[j, i] = (off * (other - other.mean())).sum()
        if endless.any():
            touched = endless.T.astype(np.float64) @ there
            for m in (squares, products):
                m[(touched > 0) | (touched.T > 0)] = np.nan
        self.merge(start, n, mean, squares, products)

    def merge(self, start: np.ndarray, n: np.ndarray, mean: np.ndarray, squares: np.ndarray, products: np.ndarray) -> None:
        self.start = np.where(np.diag(self.n) > 0, self.start, start)
        mean = mean + (start - self.start)[:, None]
        both = np.maximum(self.n + n, 1)
        apart = np.where((self.n > 0) & (n > 0), mean - self.mean, 0.0)
        weight = self.n * n / both
        self.squares += squares + apart**2 * weight
        self.products += products + apart * apart.T * weight
        self.mean = np.where(self.n > 0, self.mean + apart * n / both, mean)
        self.n += n

    @classmethod
    def of_values(cls, width: int, batches: Iterator[pa.RecordBatch]) -> CoMoments:
        total = cls(width)
        for batch in batches:
            total.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64))
        return total

    @classmethod
    def merged(cls, width: int, batches: Iterator[pa.RecordBatch]) -> CoMoments:
        total = cls(width)
        for batch in batches:
            for row in range(batch.num_rows):
                start, *matrices = (c[row].values.to_numpy() for c in batch.columns)
                total.merge(start, *(m.reshape(width, width) for m in matrices))
        return total

    def packed(self) -> pa.RecordBatch:
        """The buffer as one row."""
        matrices = (self.n, self.mean, self.squares, self.products)
        lists = [pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.reshape(-1))) for m in (self.start, *matrices)]
        return pa.record_batch(lists, ["start", "n", "mean", "squares", "products"])

    def correlations(self, names: Sequence[str]) -> pa.RecordBatch:
        """Each unordered pair once: NULL for a constant side or no rows, NaN for infinite values."""
        i, j = np.triu_indices(len(names), 1)
        spread = np.sqrt(self.squares[i, j]) * np.sqrt(self.squares[j, i])
        flat = spread == 0
        found = np.clip(self.products[i, j] / np.where(flat, 1.0, spread), -1.0, 1.0)
        at = np.array(list(names), object)
        return pa.record_batch([pa.array(at[i], pa.string()), pa.array(at[j], pa.string()), pa.array(found, mask=flat, from_pandas=False)], ["col_a", "col_b", "corr"])
