"""Column statistics: one fused aggregate, and the value-frequency table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    DIGEST_ABOVE,
    INTEGRAL_TYPES,
    as_double,
    as_identity,
    as_text,
    col,
    fields,
    half_up,
    kind,
    numeric_long,
    of_kind,
    share,
    unpivot_values,
)
from plumbline.operators.ordering import exact_quantiles

# What counts as a placeholder, and the default text format.
PLACEHOLDERS = ["n/a", "na", "none", "unknown", "-", "", "0"]
TEXT_FORMAT = r"^[a-zA-Z0-9@.\-_\s]+$"
WHITESPACE = " \t\n\r\f\x0b"

# Name parts that mark a datetime column, and its formats as text.
DATETIME_NAMES = ["date", "time", "timestamp", "datetime", "created", "updated", "dob"]
DATETIME_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd"]
DATETIME_SHAPE = r"^\d{4}[-/]\d{2}[-/]\d{2}"
EPOCH_ABOVE = 10_000_000_000

ID_NAME_V2 = r"(id|code|number|_key|_no)$"
ID_NAME_V1 = r"(id|code|number)$"


# ---------------------------------------------------------------- expressions
def is_placeholder(text: Column) -> Column:
    return F.lower(F.trim(text, F.lit(WHITESPACE))).isin(PLACEHOLDERS)


def matches_format(text: Column, pattern: str = TEXT_FORMAT) -> Column:
    return text.rlike("(?U)" + pattern)


def parse_datetime(c: Column, formats: Sequence[str] = tuple(DATETIME_FORMATS)) -> Column:
    """Text to a zone-less timestamp; NULL where no format fits. The cheap shape
    test keeps the parser, which fails slowly, away from ordinary words."""
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])
    return F.when(c.rlike(DATETIME_SHAPE), parsed)


def as_datetime(field: T.StructField) -> Column:
    if kind(field.dataType) == "datetime":
        return col(field.name).cast("timestamp_ntz")
    if isinstance(field.dataType, T.StringType):
        return parse_datetime(col(field.name))
    return F.lit(None).cast("timestamp_ntz")


def named_like_datetime(name: str) -> bool:
    return any(part in name.lower() for part in DATETIME_NAMES)


# ------------------------------------------------------------- fused aggregate
def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field_metrics(field: T.StructField, parse: bool) -> dict[str, str]:
    """Only what the class of the column needs is aggregated; the rest is constant.
    SQL text, because a wide table would otherwise cost thousands of column objects."""
    k, name = kind(field.dataType), "`" + field.name.replace("`", "``") + "`"
    fractional = isinstance(field.dataType, (T.FloatType, T.DoubleType))
    c = f"CASE WHEN NOT isnan({name}) THEN {name} END" if fractional else name
    nothing, never = "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP_NTZ)"
    out = {"non_null": f"count({c})", "placeholders": "0L", "formatted": f"count({c})"}
    out |= {"mean": nothing, "std_pop": nothing, "min": nothing, "max": nothing}
    out |= {"parsed": "0L", "min_time": never, "max_time": never}
    if k == "numeric":
        number = f"CAST({c} AS DOUBLE)"
        out |= {"mean": f"avg({number})", "std_pop": f"stddev_pop({number})", "min": f"min({number})", "max": f"max({number})"}
        if isinstance(field.dataType, INTEGRAL_TYPES):
            out["placeholders"] = f"count_if({c} = 0)"  # the only whole number that prints as a placeholder
    elif k == "text":
        text = f"hex({c})" if isinstance(field.dataType, T.BinaryType) else f"CAST({c} AS STRING)"
        listed = ", ".join(_sql_text(p) for p in PLACEHOLDERS)
        out["placeholders"] = f"count_if(lower(btrim({text}, ' \\t\\n\\r\\f\\u000b')) IN ({listed}))"
        if isinstance(field.dataType, T.StringType):
            out["formatted"] = f"count_if({c} RLIKE {_sql_text('(?U)' + TEXT_FORMAT)})"
    if k == "datetime" or (parse and isinstance(field.dataType, T.StringType)):
        if k == "datetime":
            when = f"CAST({name} AS TIMESTAMP_NTZ)"
        else:
            tried = ", ".join(f"try_to_timestamp({name}, {_sql_text(f)})" for f in DATETIME_FORMATS)
            when = f"CASE WHEN {name} RLIKE {_sql_text(DATETIME_SHAPE)} THEN CAST(coalesce({tried}) AS TIMESTAMP_NTZ) END"
        out |= {"parsed": f"count({when})", "min_time": f"min({when})", "max_time": f"max({when})"}
    return out


def column_stats(df: DataFrame, names: Sequence[str] | None = None, parse: bool = False) -> DataFrame:
    """One row per column from one scan and one aggregate, no shuffle of rows.
    ``parse`` also reads texts as datetimes."""
    chosen = fields(df, names)
    if not chosen:
        raise ValueError("the table has no columns")
    aggregates, structs = ["count(1) AS n"], []
    for i, field in enumerate(chosen):
        metrics = _field_metrics(field, parse)
        aggregates += [f"{m} AS m{i}_{name}" for name, m in metrics.items()]
        described = [
            f"{i} AS position",
            f"{_sql_text(field.name)} AS column_name",
            f"{_sql_text(field.dataType.simpleString())} AS type",
            f"{_sql_text(kind(field.dataType))} AS kind",
            "n",
            *[f"m{i}_{name} AS {name}" for name in metrics],
        ]
        structs.append(f"struct({', '.join(described)})")
    long = df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(structs)}))")
    return long.withColumn("std", F.expr("CASE WHEN non_null > 1 THEN std_pop * sqrt(non_null / (non_null - 1D)) END"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Each column's place, type and kind, and the values found in it; one scan."""
    counted = df.agg(*[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema)])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(kind(f.dataType)).alias("kind"), F.col(f"n{i}").alias("non_null"))
        for i, f in enumerate(df.schema)
    ]
    return counted.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------- value frequencies
def value_counts(df: DataFrame, names: Sequence[str], value=as_text, keep_missing: str | None = None) -> DataFrame:
    """(column_name, value, n). Counted on the map side, so hot values are cheap."""
    long = unpivot_values(df, names, value)
    if keep_missing is not None:
        long = long.withColumn("value", F.coalesce("value", F.lit(keep_missing)))
    else:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def typed_counts(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Value counts split by storage class: whole numbers and doubles are counted
    as numbers (narrow shuffle rows), everything else as text or its digest."""
    groups: dict[str, list[str]] = {}
    for field in fields(df, names):
        if isinstance(field.dataType, INTEGRAL_TYPES):
            groups.setdefault("whole", []).append(field.name)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            groups.setdefault("real", []).append(field.name)
        else:
            groups.setdefault("text", []).append(field.name)
    value = {"whole": lambda f: col(f.name).cast("bigint"), "real": as_double, "text": as_identity}
    return {g: value_counts(df, chosen, value[g]) for g, chosen in groups.items()}


def numeric_counts(typed: dict[str, DataFrame]) -> DataFrame:
    """(column_name, value double, n) from the numeric groups of ``typed_counts``."""
    parts = [
        c.withColumn("value", F.col("value").cast("double")) for g, c in typed.items() if g in ("whole", "real")
    ]
    return reduce(DataFrame.unionByName, parts)


def distinct_stats(
    df: DataFrame, names: Sequence[str] | None = None, typed: dict[str, DataFrame] | None = None
) -> DataFrame:
    """(column_name, n_unique, entropy) over non-missing values."""
    p = F.expr("n / CAST(total AS DOUBLE)")
    parts = []
    for counts in (typed or typed_counts(df, names)).values():
        totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
        parts.append(
            counts.join(F.broadcast(totals), "column_name")  # one row per column
            .groupBy("column_name")
            .agg(F.count("*").alias("n_unique"), (-F.sum(p * F.log(p + F.lit(1e-9)))).alias("entropy"))
        )
    return reduce(DataFrame.unionByName, parts)


def approx_distinct_stats(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Sketch form of ``distinct_stats`` (no shuffle, no entropy)."""
    names = list(names if names is not None else df.columns)
    aggregated = df.agg(*[F.approx_count_distinct(as_identity(f)).alias(f.name) for f in fields(df, names)])
    return aggregated.unpivot([], [col(n) for n in names], "column_name", "n_unique").withColumn(
        "entropy", F.lit(None).cast("double")
    )


def top_values(df: DataFrame, names: Sequence[str], k: int = 3, typed: dict[str, DataFrame] | None = None) -> DataFrame:
    """k most frequent values per column, ties by value.

    They are ranked from the typed value counts, which a profile has already (``typed``, over the same columns): numbers
    are turned into text only after counting. The rank filter is applied on the map side too (window group limit), so a
    near-unique column does not land in one task. Columns that hold long texts are ranked by ``_top_long``.
    """
    names = list(names)
    long = _long_columns(df, names)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    if typed is None:
        short = [n for n in names if n not in long]
        typed = typed_counts(df, short) if short else {}
    texts = [_counted_texts(df, group, counts) for group, counts in typed.items()]
    parts = []
    if texts:
        ranked = reduce(DataFrame.unionByName, texts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # The rank in this test keeps it above the counting, whose shuffle is then the one the profile has.
        parts.append(ranked.filter(~F.col("column_name").isin(long) | (F.col("rank") < 0)) if long else ranked)
    if long:
        rows = [(n, value, count, rank) for n in long for rank, (value, count) in enumerate(_top_long(df, n, k), 1)]
        parts.append(df.sparkSession.createDataFrame(rows, "column_name string, value string, n long, rank int"))
    return reduce(DataFrame.unionByName, parts)


def _counted_texts(df: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """Counts of ``typed_counts`` with the values as ``as_text`` writes them."""
    value = F.col("value").cast("string")
    narrow = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType)]
    if group == "real" and narrow:
        value = F.when(F.col("column_name").isin(narrow), F.col("value").cast("float").cast("string")).otherwise(value)
    return counts.select("column_name", value.alias("value"), "n")


def _long_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns with a text of more than DIGEST_ABOVE characters; one scan, if any column can hold one."""
    able = [f for f in fields(df, names) if kind(f.dataType) in ("text", "nested") and not isinstance(f.dataType, T.BooleanType)]
    if not able:
        return []
    longest = df.agg(*[F.max(F.length(as_text(f))).alias(f"c{i}") for i, f in enumerate(able)]).first()
    return [f.name for f, length in zip(able, longest, strict=True) if (length or 0) > DIGEST_ABOVE]


def _top_long(df: DataFrame, name: str, k: int) -> list[tuple[str, int]]:
    """The k most frequent (value, n) of a column of long texts, ties by value, without shuffling the texts.

    They are counted by digest beside their first DIGEST_ABOVE characters, which decide nearly every tie. Whole texts
    are fetched for the few digests that are left, by a filter.
    """
    field = df.schema[name]
    texts = df.select(as_text(field).alias("text")).filter(F.col("text").isNotNull())
    head, digest = F.left("text", F.lit(DIGEST_ABOVE)), F.when(F.length("text") > DIGEST_ABOVE, F.sha2("text", 256))
    counts = texts.groupBy(head.alias("head"), digest.alias("digest")).agg(F.count("*").alias("n"))
    window = 4 * k + 16
    seen = counts.orderBy(F.desc("n"), "head", F.asc_nulls_first("digest")).limit(window).collect()
    groups = [(key, [r["digest"] for r in rows]) for key, rows in groupby(seen, lambda r: (r["n"], r["head"], r["digest"] is None))]
    chosen: list[tuple[int, str, list[str], int]] = []  # count, head, digests, how many of them
    left = k
    for place, ((n, start, whole), digests) in enumerate(groups):
        need = min(left, len(digests))
        if need and not whole and place == len(groups) - 1 and len(seen) == window:
            digests = _least_digests(texts.filter((head == start) & digest.isNotNull()), n, need)
        if need:
            chosen.append((n, start, [] if whole else digests, need))
        left -= need
    wanted = [d for _, _, digests, _ in chosen for d in digests]
    fetched = {}
    if wanted:
        fetched = dict(texts.filter(digest.isin(wanted)).groupBy(digest.alias("digest")).agg(F.first("text").alias("text")).collect())
    out = []
    for n, start, digests, need in chosen:
        values = sorted((fetched[d] for d in digests), key=str.encode) if digests else [start]
        out += [(v, n) for v in values[:need]]
    return out


def _least_digests(texts: DataFrame, n: int, need: int) -> list[str]:
    """Digests of the least texts that occur n times each. The least rows are taken, more until enough of them fit."""
    digest, rows = F.sha2("text", 256), 256
    while True:
        least = [r[0] for r in texts.orderBy("text").limit(rows).select(digest).collect()]
        found = list(dict.fromkeys(least))
        counted = dict(texts.filter(digest.isin(found)).groupBy(digest.alias("digest")).count().collect())
        fit = [d for d in found if counted[d] == n]
        if len(fit) >= need or len(least) < rows:
            return fit[:need]
        rows *= 8


def levels(df: DataFrame, limit: int = 50, names: Sequence[str] | None = None) -> DataFrame:
    """(column_name, levels): the number of distinct values where it is at most ``limit``, else NULL.

    One aggregate without a shuffle of values: a theta sketch keeps all hashes until it is full, so up to its size the
    count is exact; past it the estimate is above its size, and so above ``limit``.
    """
    chosen = fields(df, names)
    size = max(4, limit.bit_length())  # 2^size > limit
    seen = [F.when(as_text(f).isNotNull(), F.xxhash64(as_text(f))) for f in chosen]
    wide = df.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(c, size)).alias(f"c{i}") for i, c in enumerate(seen)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.when(F.col(f"c{i}") <= limit, F.col(f"c{i}")).cast("long").alias("levels")) for i, f in enumerate(chosen)]
    return wide.select(F.inline(F.array(*rows)))


def joined_top_values(
    df: DataFrame, names: Sequence[str], k: int = 3, separator: str = ", ", typed: dict[str, DataFrame] | None = None
) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return (
        top_values(df, names, k, typed)
        .groupBy("column_name")
        .agg(F.array_join(F.transform(listed, lambda s: s["value"]), separator).alias("top_values"))
    )


# -------------------------------------------------------------------- profiles
def _with_distinct(
    df: DataFrame,
    names: Sequence[str] | None,
    approx: bool = False,
    parse: bool = False,
    base: DataFrame | None = None,
    typed: dict[str, DataFrame] | None = None,
) -> DataFrame:
    base = base if base is not None else column_stats(df, names, parse)
    distinct = approx_distinct_stats(df, names) if approx else distinct_stats(df, names, typed)
    joined = base.join(F.broadcast(distinct), "column_name", "left")
    filled = {"n_unique": F.coalesce("n_unique", F.lit(0))}
    if not approx:
        filled["entropy"] = F.coalesce("entropy", F.lit(0.0))
    return joined.withColumns(filled)


def missing_pct() -> Column:
    return F.coalesce(100 * (1 - share(F.col("non_null"), F.col("n"))), F.lit(0.0))


def basic_profile(df: DataFrame, names: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    names = list(names if names is not None else df.columns)
    typed = typed_counts(df, names)  # counted once, for the distinct values and the most frequent ones
    # The test of n keeps it in the counts, so that both readers have the same shuffle.
    distinct = reduce(DataFrame.unionByName, [c.groupBy("column_name").agg(F.count_if(F.col("n") > 0).alias("n_unique")) for c in typed.values()])
    return (
        column_stats(df, names)
        .join(F.broadcast(distinct), "column_name", "left")
        .withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
        .join(F.broadcast(joined_top_values(df, names, k, typed=typed)), "column_name", "left")
        .select(
            "position",
            "column_name",
            "type",
            missing_pct().alias("missing_pct"),
            F.col("n_unique").alias("unique_values"),
            "min",
            "max",
            "mean",
            "top_values",
        )
    )


def dashboard_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return _with_distinct(df, names).select(
        "column_name",
        "type",
        half_up(missing_pct(), 2).alias("missing_pct"),
        F.col("n_unique").alias("unique_values"),
    )


def top_missing_columns(df: DataFrame, k: int = 3) -> DataFrame:
    return (
        column_stats(df)
        .select("column_name", "position", missing_pct().alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "position")
        .limit(k)
        .drop("position")
    )


def advanced_stats(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return _with_distinct(df, names).select(
        "column_name",
        "type",
        missing_pct().alias("null_pct"),
        F.col("n_unique").alias("unique_count"),
        "mean",
        "std",
        "min",
        "max",
        F.coalesce(100 * share(F.col("n_unique"), F.col("n")), F.lit(0.0)).alias("uniqueness_pct"),
    )


def date_stats(df: DataFrame, as_of: str, names: Sequence[str] | None = None) -> DataFrame:
    names = list(names if names is not None else of_kind(df, "datetime"))
    return column_stats(df, names).select(
        "column_name",
        "max_time",
        "min_time",
        whole_days(as_of, F.col("max_time")).alias("freshness_days"),
    )


def whole_days(as_of: str, moment: Column) -> Column:
    """Whole 24 h periods from ``moment`` to ``as_of`` (floor, so the future is negative)."""
    seconds = F.unix_seconds(ntz(as_of).cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))
    fraction = F.when(F.date_format(moment, "SSSSSS") != "000000", F.lit(1)).otherwise(F.lit(0))
    return F.floor((seconds - fraction) / F.lit(86400.0)).cast("bigint")


def ntz(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def numeric_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """min, max, mean, std, median, n_unique after coercing to numbers."""
    long = numeric_long(df, names)
    basic = long.groupBy("column_name").agg(
        F.count("*").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    unique = long.groupBy("column_name", "value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(
        F.count("*").alias("n_unique")
    )
    median = exact_quantiles(long, ["column_name"], [0.5]).select(
        "column_name", F.col("quantiles")[0].alias("median")
    )
    return basic.join(F.broadcast(unique), "column_name").join(F.broadcast(median), "column_name")


def completeness(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return column_stats(df, names).select(
        "column_name",
        "n",
        "non_null",
        F.coalesce(share(F.col("non_null"), F.col("n")), F.lit(0.0)).alias("completeness"),
        missing_pct().alias("missing_pct"),
    )


def placeholder_ratio(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return column_stats(df, names).select(
        "column_name", F.coalesce(share(F.col("placeholders"), F.col("non_null")), F.lit(0.0)).alias("placeholder_ratio")
    )


def uniqueness(df: DataFrame, names: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    ratio = F.coalesce(share(F.col("n_unique"), F.col("n")), F.lit(0.0))
    return _with_distinct(df, names, approx).select(
        "column_name", "n_unique", ratio.alias("uniqueness"), (100 * (1 - ratio)).alias("duplicate_pct")
    )


def entropy(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return _with_distinct(df, names).select("column_name", "entropy")


#: From here on the older tool writes doubles with a plus sign in the exponent, which its format does not allow.
PLUS_FROM = 1e16


def format_consistency(df: DataFrame, names: Sequence[str] | None = None, pattern: str | None = None, compat: bool = False) -> DataFrame:
    """Share of matching texts; numbers match. A pattern of the caller's is tested on every class. ``compat`` counts
    doubles whose older text has a plus sign as mismatches."""
    names = list(names if names is not None else df.columns)
    if pattern is None:
        counted = column_stats(df, names).select("column_name", "formatted", "non_null")
    else:
        long = unpivot_values(df, names, as_text)
        counted = long.groupBy("column_name").agg(
            F.count_if(matches_format(F.col("value"), pattern)).alias("formatted"), F.count("value").alias("non_null")
        )
    real = [f for f in fields(df, names) if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if compat and pattern is None and real:
        large = [F.count_if((F.abs(as_double(f)) >= PLUS_FROM) & (F.abs(as_double(f)) < float("inf"))).alias(f.name) for f in real]
        plus = df.agg(*large).unpivot([], [col(f.name) for f in real], "column_name", "plus")
        counted = counted.join(F.broadcast(plus), "column_name", "left").withColumn("formatted", F.col("formatted") - F.coalesce("plus", F.lit(0)))
    return counted.select(
        "column_name", F.coalesce(share(F.col("formatted"), F.col("non_null")), F.lit(1.0)).alias("format_consistency")
    )


def range_conformity(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Share of values within [lo, hi]; an open side takes the observed extreme, so it always holds."""
    aggregates = []
    for name, (lo, hi) in bounds.items():
        field = df.schema[name]
        if kind(field.dataType) != "numeric":
            aggregates.append(F.lit(1.0).alias(name))
            continue
        v = as_double(field)
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (v >= lo)
        if hi is not None:
            inside = inside & (v <= hi)
        aggregates.append(
            F.coalesce(share(F.count_if(v.isNotNull() & inside), F.count(v)), F.lit(1.0)).alias(name)
        )
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return wide.unpivot([], [col(n) for n in bounds], "column_name", "range_conformity")


def dtype_conformity(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    held = F.coalesce(share(F.col("non_null"), F.col("n")), F.lit(1.0))
    return column_stats(df, names).select(
        "column_name", F.when(F.col("kind") == "datetime", held).otherwise(F.lit(1.0)).alias("dtype_conformity")
    )


def validity(dtype: Column, fmt: Column, rng: Column, referential: Column) -> Column:
    return (dtype + fmt + rng + F.coalesce(referential, F.lit(1.0))) / 4


def detect_id_v2() -> Column:
    """Over a profile row (column_name, type, kind, n, n_unique)."""
    named = F.lower("column_name").rlike(ID_NAME_V2) & (F.col("n_unique") >= 0.9 * F.col("n"))
    id_type = F.col("type").isin("tinyint", "smallint", "int", "bigint", "string")
    full = (F.col("n_unique") == F.col("n")) & (F.col("n") > 0) & id_type
    return named | full


def detect_id_v1() -> Column:
    return F.lower("column_name").rlike(ID_NAME_V1) & (F.col("n_unique") == F.col("n"))


def detect_datetime() -> Column:
    """Over a profile row: by name, by parse rate of texts, or by epoch-like size.
    The size test speaks of 'values', so a table without rows is never a datetime by it."""
    named = F.lower("column_name").rlike("|".join(re.escape(p) for p in DATETIME_NAMES))
    parsed = (F.col("parsed") > 0.7 * F.col("non_null")) & (F.col("non_null") > 0)
    epoch = (F.col("kind") == "numeric") & (F.col("mean") > EPOCH_ABOVE)
    return named | F.coalesce(parsed, F.lit(False)) | F.coalesce(epoch, F.lit(False))


def column_flags(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return _with_distinct(df, names, parse=True).select(
        "column_name",
        "n",
        "n_unique",
        detect_id_v2().alias("is_id"),
        detect_id_v1().alias("is_id_v1"),
        detect_datetime().alias("is_datetime"),
    )


def low_cardinality(df: DataFrame, limit: int = 50) -> DataFrame:
    """The number of distinct values of every column, and which of the columns other than numbers have at most ``limit``."""
    return _with_distinct(df, None).select(
        "column_name", "n_unique", ((F.col("n_unique") <= limit) & (F.col("kind") != "numeric")).alias("is_low_cardinality")
    )


def mean_text_length(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    chosen = fields(df, names)
    wide = df.agg(*[F.avg(F.length(as_text(f))).alias(f.name) for f in chosen])
    return wide.unpivot([], [col(f.name) for f in chosen], "column_name", "mean_length")


def sample_values(df: DataFrame, names: Sequence[str], k: int = 5) -> DataFrame:
    """k values per column, most frequent first, ties by value."""
    return top_values(df, names, k).select("column_name", "rank", "value", "n")


EXPLORE_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def explorative_profile(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """All columns in one table: counts for every class, moments and percentiles of numbers, lengths of texts, ends of
    datetimes, the most frequent value of the others, and the table's number of duplicate rows."""
    names = list(names if names is not None else df.columns)
    numeric, textual = of_kind(df, "numeric", names=names), of_kind(df, "text", names=names)
    others = [n for n in names if n not in numeric]
    out = _with_distinct(df, names).withColumnsRenamed({"n": "rows", "n_unique": "distinct_values"})
    measured = {"zeros": "long", "skewness": "double", "kurtosis": "double", "quantiles": "array<double>"}
    if numeric:
        long = numeric_long(df, numeric)
        moments = long.groupBy("column_name").agg(
            F.count_if(F.col("value") == 0).alias("zeros"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis")
        )
        quantiles = exact_quantiles(long, ["column_name"], EXPLORE_PROBS).select("column_name", "quantiles")
        out = out.join(F.broadcast(moments), "column_name", "left").join(F.broadcast(quantiles), "column_name", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in measured.items()})
    if textual:
        size = {n: F.length(as_text(df.schema[n])) for n in textual}
        wide = df.agg(*[f(size[n]).alias(f"{k}{i}") for i, n in enumerate(textual) for k, f in (("a", F.min), ("b", F.max))])
        rows = [F.struct(F.lit(n).alias("column_name"), F.col(f"a{i}").alias("shortest"), F.col(f"b{i}").alias("longest")) for i, n in enumerate(textual)]
        out = out.join(F.broadcast(wide.select(F.inline(F.array(*rows)))), "column_name", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("int") for c in ("shortest", "longest")})
    if others:
        top = top_values(df, others, 1).select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_n"))
        out = out.join(F.broadcast(top), "column_name", "left")
    else:
        out = out.withColumns({"top_value": F.lit(None).cast("string"), "top_n": F.lit(None).cast("long")})
    repeated = duplicate_rows(df).select("duplicate_rows").scalar()
    return out.select(
        "column_name",
        "kind",
        "rows",
        (F.col("rows") - F.col("non_null")).alias("missing"),
        "distinct_values",
        F.when(F.col("kind") == "numeric", F.coalesce("zeros", F.lit(0))).alias("zeros"),
        "mean",
        "std",
        "skewness",
        "kurtosis",
        *[F.col("quantiles")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(EXPLORE_PROBS)],
        "shortest",
        "longest",
        "min_time",
        "max_time",
        "top_value",
        "top_n",
        repeated.alias("duplicate_rows"),
    )


def duplicate_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row: rows minus distinct rows."""
    chosen = [as_identity(f).alias(f"c{i}") for i, f in enumerate(fields(df, names))]
    grouped = df.select(*chosen).groupBy(*[f"c{i}" for i in range(len(chosen))]).agg(F.count("*").alias("n"))
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicate_rows"),
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def first_rows(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    return df.orderBy(*[col(c) for c in order]).limit(k)
