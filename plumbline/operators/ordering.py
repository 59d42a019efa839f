"""Global order without a single-task window.

A window without a partition key, or keyed by column name only, would pull a
whole column into one task. Here the value range of each column is cut by
approximate quantiles (``Cuts``), rows are sorted inside a (key, range) group
only, and the per-range totals carry the running sums across ranges. Ranges that
still hold too many rows are cut once more, each by its own count, so what one
task sorts is bounded by ROWS_PER_RANGE while the ranges grow in number. Equal
values are collapsed to one counted row first, so a hot value costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The cuts only decide how work is spread, never a result.
ROWS_PER_RANGE = 250_000
COARSE_RANGES = 256
MAX_RANGES = 4096  # of a column, and again of a range
CUT_SAMPLE = 0.02
BROADCAST_POINTS = 1 << 22  # second-level points (32 MB) that are sent to all tasks; more are joined
TEXT_RANGES, TEXT_ROWS_PER_RANGE = 64, 10_000
CUT_CHARS = 1 << 22  # of all cut points of a text column


@dataclass(frozen=True)
class Cuts:
    """Sorted cut points per column: a driver-side list of bounded size. ``fine`` has the points inside a range that is
    cut once more, by (column, range): one point for ROWS_PER_RANGE rows."""

    spark: SparkSession
    points: dict[str, list]
    value_type: str = "double"
    fine: dict[tuple[str, int], list] = field(default_factory=dict)

    @property
    def steps(self) -> int:
        longest = max((len(p) for p in self.points.values()), default=0)
        return max(1, longest.bit_length())

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(k, p) for k, p in self.points.items()], f"column_name string, cuts array<{self.value_type}>"
        )

    def fine_table(self) -> DataFrame:
        rows = [(k, r, p) for (k, r), p in self.fine.items()]
        return self.spark.createDataFrame(rows, f"column_name string, range_id int, cuts array<{self.value_type}>")


def _thin(points: Sequence, rows: int, rows_per_range: int, least: int = 4) -> list:
    wanted = least
    while wanted < MAX_RANGES and wanted * rows_per_range < rows:
        wanted *= 2
    step = max(1, len(points) // wanted)
    return sorted(set(points[step - 1 :: step]))


def numeric_cuts(long: DataFrame, rows_per_range: int | None = None) -> Cuts:
    """Cut points of (column_name, value double): one pass over a 2 % sample with
    map-side sketches. Cuts balance work and never decide a result, so a sample
    is enough; they are fixed here, once, and reach every task as constants."""

    rows_per_range = rows_per_range or ROWS_PER_RANGE

    def sketch(ranges: int):
        grid = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
        points = F.expr(f"percentile_approx(value, array({grid}), {8 * ranges})")
        sampled = long.sample(CUT_SAMPLE, seed=11).groupBy("column_name")
        return sampled.agg(F.count("value").alias("n"), points.alias("p")).collect()

    def estimated(row) -> int:
        return int(row["n"] / CUT_SAMPLE)

    rows = sketch(COARSE_RANGES)
    if any(estimated(r) > COARSE_RANGES * rows_per_range for r in rows):
        rows = sketch(MAX_RANGES)
    points = {r["column_name"]: _thin(r["p"] or [], estimated(r), rows_per_range) for r in rows}
    cuts = Cuts(long.sparkSession, points)
    if not any(estimated(r) > MAX_RANGES * rows_per_range for r in rows):
        return cuts
    grid = ", ".join(f"{i / MAX_RANGES}D" for i in range(1, MAX_RANGES))
    inside = with_range(long.sample(CUT_SAMPLE, seed=13), cuts).groupBy("column_name", "range_id")
    again = inside.agg(F.count("*").alias("n"), F.expr(f"percentile_approx(value, array({grid}), {8 * MAX_RANGES})").alias("p"))
    crowded = again.filter(F.col("n") > CUT_SAMPLE * rows_per_range).collect()
    fine = {(r["column_name"], r["range_id"]): _thin(r["p"], estimated(r), rows_per_range, 2) for r in crowded}
    return replace(cuts, fine={k: p for k, p in fine.items() if len(p) > 1})


def text_cuts(values: DataFrame, column: str) -> Cuts:
    """Cut points of a text column: beginnings of a hash sample of its distinct values. They grow until they tell the
    sampled values apart, so a long common beginning does not put all values into one range."""
    distinct = values.agg(F.approx_count_distinct(column)).first()[0] or 0
    wanted = min(MAX_RANGES, max(TEXT_RANGES, distinct // TEXT_ROWS_PER_RANGE))
    every = max(1, distinct // (8 * wanted))
    sampled = values.filter(F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(every)) == 0)
    length = 64
    while True:
        begun = sampled.groupBy(F.xxhash64(column).alias("h")).agg(F.first(F.left(column, F.lit(length))).alias("head"), F.max(F.length(column)).alias("size"))
        rows = begun.orderBy("head").limit(16 * wanted).collect()  # twice what the sample should hold
        heads = [r["head"] for r in rows]
        apart = len(set(heads)) >= 0.9 * len(heads) or all(r["size"] <= length for r in rows)
        if apart or 4 * length * TEXT_RANGES > CUT_CHARS:
            break
        length *= 4
    number = max(1, min(wanted, CUT_CHARS // length))
    step = max(1, len(heads) // number)
    return Cuts(values.sparkSession, {"": sorted(set(heads[step - 1 :: step]), key=str.encode)}, "string")


def count_below_sql(array: str, value: str, steps: int, out: str) -> tuple[list[str], list[str]]:
    """SQL columns of an unrolled binary search, each using the one before it, and
    the names of the helpers among them. ``out`` = how many entries of the sorted
    ``array`` are below ``value``. It stays inside generated code, unlike an
    interpreted higher-order function."""
    columns, helpers, at = [], [], "0"
    for power in reversed(range(steps)):
        name = out if power == 0 else f"_{out}_{power}"
        columns.append(f"{at} + CASE WHEN get({array}, {at} + {2**power - 1}) < {value} THEN {2**power} ELSE 0 END AS {name}")
        helpers += [name] if power else []
        at = name
    return columns, helpers


def count_below(df: DataFrame, array: str, value: str, steps: int, out: str) -> DataFrame:
    columns, helpers = count_below_sql(array, value, steps, out)
    return df.selectExpr("*", *columns).drop(*helpers)


def with_range(df: DataFrame, cuts: Cuts, value: str = "value") -> DataFrame:
    """Add ``range_id``; ``df`` carries ``column_name`` unless the cuts are unnamed."""
    table = cuts.table()
    if set(cuts.points) == {""}:
        joined = df.withColumn("cuts", F.lit(cuts.points[""]).cast(f"array<{cuts.value_type}>"))
    else:
        joined = df.join(F.broadcast(table), "column_name", "left")
    ranged = count_below(joined, "cuts", f"`{value}`", cuts.steps, "range_id").drop("cuts")
    if not cuts.fine:
        return ranged
    table = cuts.fine_table()
    if sum(map(len, cuts.fine.values())) <= BROADCAST_POINTS:
        table = F.broadcast(table)
    steps = max(p.bit_length() for p in map(len, cuts.fine.values()))
    inner = count_below(ranged.join(table, ["column_name", "range_id"], "left"), "cuts", f"`{value}`", steps, "_inner").drop("cuts")
    return inner.withColumn("range_id", F.col("range_id").cast("long") * (1 << 32) + F.col("_inner")).drop("_inner").select(*ranged.columns)


def running_totals(
    counted: DataFrame, keys: Sequence[str], counts: Sequence[str], cuts: Cuts, value: str = "value"
) -> DataFrame:
    """Add ``cum_<count>`` (inclusive, ordered by value) and ``total_<count>`` per key.

    ``counted`` has one row per (keys, value) and the key columns are not null.
    """
    ranged = with_range(counted, cuts, value)
    group = [*keys, "range_id"]
    sums = ranged.groupBy(*group).agg(*[F.sum(c).alias(f"_sum_{c}") for c in counts])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in counts],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in counts],
    )
    inside = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, group)
    return joined.select(
        *counted.columns,
        *[(F.col(f"_off_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in counts],
        *[f"total_{c}" for c in counts],
    )


def wanted_ranks(probs: Sequence[float], total: str) -> str:
    """SQL for the sorted ranks (from 0) that the probabilities need."""
    both = ", ".join(f"floor({float(p)}D * ({total} - 1)), ceil({float(p)}D * ({total} - 1))" for p in probs)
    return f"array_sort(array_distinct(array({both})))"


def with_held_ranks(ranked: DataFrame, ranks: str, first: str, last: str, n_probs: int) -> DataFrame:
    """Add ``held``: the wanted ranks in [first, last), NULL where there is none.
    ``ranks``, ``first`` and ``last`` are SQL."""
    steps = (2 * n_probs).bit_length()
    start, start_helpers = count_below_sql(ranks, f"({first})", steps, "_start")
    stop, stop_helpers = count_below_sql(ranks, f"({last})", steps, "_stop")
    held = f"CASE WHEN _stop > _start THEN slice({ranks}, _start + 1, _stop - _start) END AS held"
    return ranked.selectExpr("*", *start, *stop, held).drop("_start", "_stop", *start_helpers, *stop_helpers)


def collected_ranks(value: str = "value") -> Column:
    """Aggregate: rank -> value; two entries per probability at most."""
    entries = f"collect_list(CASE WHEN held IS NOT NULL THEN transform(held, r -> struct(r, {value})) END)"
    return F.expr(f"map_from_entries(flatten({entries}))")


def quantiles_at(probs: Sequence[float], at: str, n: str) -> Column:
    return F.expr(f"array({', '.join(_interpolated(float(p), at, n) for p in probs)})")


def _interpolated(p: float, at: str, n: str) -> str:
    low, high = f"{at}[floor({p}D * ({n} - 1))]", f"{at}[ceil({p}D * ({n} - 1))]"
    return f"{low} + ({high} - {low}) * ({p}D * ({n} - 1) - floor({p}D * ({n} - 1)))"


def exact_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    cuts: Cuts | None = None,
    few_keys: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key without shuffling the data.

    Rows are counted per value range with map-side combine; only the ranges that
    hold a wanted rank are then sorted, and only the rows that hold one go on.
    ``long`` = (column_name, keys..., value), missing values removed. ``weight``
    names a count column where there is one row per (keys, value) already.
    ``few_keys`` says that the number of keys is bounded (columns, months), so the
    wanted ranges - at most two per key and probability - may be broadcast.
    Result: keys, n, quantiles.
    """
    cuts = cuts or numeric_cuts(long)
    ranged = with_range(long, cuts)
    group = [*keys, "range_id"]
    per_range = ranged.groupBy(*group).agg((F.sum(weight) if weight else F.count("*")).alias("m"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_range.select(
        *group,
        F.col("m"),
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"),
        F.sum("m").over(whole).alias("total"),
    ).withColumn("ranks", F.expr(wanted_ranks(probs, "total")))
    wanted = placed.filter("exists(ranks, r -> r >= offset AND r < offset + m)").select(*group, "offset", "total", "ranks")
    wanted = F.broadcast(wanted) if few_keys else wanted
    if weight:
        counted = ranged.withColumn("m", F.col(weight))
    else:
        held = ranged.join(wanted.select(*group), group, "left_semi")
        counted = held.groupBy(*group, "value").agg(F.count("*").alias("m"))
    joined = counted.join(wanted, group)
    inside = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = joined.withColumn("last", F.col("offset") + F.sum("m").over(inside))
    held = with_held_ranks(ranked, "ranks", "last - m", "last", len(probs))
    # No filter on ``held``: it would be pushed into the unrolled search and double at every step; the aggregate skips NULLs.
    at = held.groupBy(*keys).agg(F.max("total").alias("n"), collected_ranks().alias("at"))
    return at.select(*keys, "n", quantiles_at(probs, "at", "n").alias("quantiles"))
