"""Poisson bootstrap sums per stratum, as arrays with one entry a replicate that tasks fill and merge."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# executors get the functions themselves and need not have this package installed
register_pickle_by_value(sys.modules[__name__])

SUMS = "stratum string, sums array<double>"
EFFECTS = "gained array<double>, weight array<double>"
HELD = 4096  # strata that a task adds up before it passes them on


def poisson_weights(lots: np.ndarray, replicates: int) -> np.ndarray:
    """Rows x replicates draws of Poisson(1). A draw depends on the row's 64-bit lot and the replicate alone."""
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = lots.astype(np.uint64)[:, None] + steps[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finalizer of splitmix64
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    unit = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(below, unit, side="right").astype(np.float64)


def stratum_sums(strata: pa.Array, treated: np.ndarray, outcome: np.ndarray, lots: np.ndarray, replicates: int) -> Iterator[tuple[str, np.ndarray]]:
    """(stratum, array of n1, n0, y1, y0 by replicate) over some rows; ``treated`` is 1, 0, or else for rows of no arm."""
    coded = strata.dictionary_encode()
    arm = coded.indices.to_numpy().astype(np.int64) * 2 + (treated == 1)
    order = np.flatnonzero((treated == 0) | (treated == 1))
    order = order[np.argsort(arm[order], kind="stable")]
    if not len(order):
        return
    arm = arm[order]
    first = np.flatnonzero(np.r_[True, arm[1:] != arm[:-1]])
    weights = poisson_weights(lots[order], replicates)
    counts = np.add.reduceat(weights, first, axis=0)
    totals = np.add.reduceat(weights * outcome[order][:, None], first, axis=0)
    found: dict[int, np.ndarray] = {}
    for place, a in enumerate(arm[first]):
        sums = found.setdefault(int(a) // 2, np.zeros((4, replicates)))
        sums[1 - a % 2], sums[3 - a % 2] = counts[place], totals[place]
    for code, sums in found.items():
        yield coded.dictionary[code].as_py(), sums


def fill(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Rows (stratum, treated, outcome, lot) to the sums of the strata; a missing outcome adds nothing."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        outcome = np.nan_to_num(batch["outcome"].to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
        treated = batch["treated"].to_numpy(zero_copy_only=False)
        for at in range(0, batch.num_rows, 4096):
            part = slice(at, at + 4096)
            for stratum, sums in stratum_sums(batch["stratum"].slice(at, 4096), treated[part], outcome[part], batch["lot"].to_numpy()[part], replicates):
                held[stratum] = held[stratum] + sums if stratum in held else sums
        if len(held) > HELD:
            yield _packed(held)
            held = {}
    yield _packed(held)


def _packed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array([s.reshape(-1) for s in held.values()], pa.list_(pa.float64()))], ["stratum", "sums"])


def effects(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Sums sorted by stratum to one row: over this task's strata with both arms, rows times gap, and rows."""
    gained, weight = np.zeros(replicates), np.zeros(replicates)
    now, total = None, np.zeros((4, replicates))

    def close() -> None:
        n1, n0, y1, y0 = total
        both = (n1 > 0) & (n0 > 0)
        gap = y1 / np.where(both, n1, 1) - y0 / np.where(both, n0, 1)
        gained[:] += np.where(both, (n1 + n0) * gap, 0.0)
        weight[:] += np.where(both, n1 + n0, 0.0)

    for batch in batches:
        for stratum, sums in zip(batch["stratum"].to_pylist(), batch["sums"], strict=True):
            if stratum != now:
                close()
                now, total = stratum, np.zeros((4, replicates))
            total = total + sums.values.to_numpy().reshape(4, replicates)
    close()
    yield pa.record_batch([pa.array([gained], pa.list_(pa.float64())), pa.array([weight], pa.list_(pa.float64()))], ["gained", "weight"])


def interval(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """The 2.5, 50 and 97.5 % points of the replicates that have an effect, and their number."""
    gained, weight = np.zeros(replicates), np.zeros(replicates)
    for batch in batches:
        for g, w in zip(batch["gained"], batch["weight"], strict=True):
            gained += g.values.to_numpy()
            weight += w.values.to_numpy()
    found = gained[weight > 0] / weight[weight > 0]
    low, middle, high = np.percentile(found, [2.5, 50, 97.5]) if len(found) else (None, None, None)
    columns = {"ci_low": low, "ate_median": middle, "ci_high": high}
    yield pa.record_batch({c: pa.array([v], pa.float64()) for c, v in columns.items()} | {"replicates": pa.array([len(found)], pa.int64())})
