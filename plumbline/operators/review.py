"""Semantic review: sampling rows for a reviewer and folding verdicts back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col

BATCHES, BATCH_ROWS = 5, 10
MAX_REASONS, MAX_EXAMPLES, MAX_DESCRIPTIONS = 5, 3, 3
MAX_NUMERIC_EXAMPLES = 5
# Verdicts, the flags they raise, and the description of a column without findings.
NOTHING_FOUND = "No semantic inconsistencies detected."
CATEGORY_FLAG = "Classification might be wrong"
NUMERIC_FLAG = "Logical or semantic inconsistency"
SIGNAL_LIMIT = 0.5


def sample_cap(df: DataFrame, key: str, rows: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows in key-hash order; None keeps everything."""
    if rows is None:
        return df
    return df.orderBy(F.xxhash64(col(key), F.lit(seed)), col(key)).limit(rows)


def sample_batches(
    df: DataFrame, key: str, batches: int = BATCHES, size: int = BATCH_ROWS, seed: int = 42
) -> DataFrame:
    """Seeded batches of rows for review. Every row has a batch by key hash, and
    the rank filter runs on the map side first (window group limit)."""
    batch = F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(batches)).cast("int")
    order = Window.partitionBy("batch").orderBy(F.xxhash64(col(key), F.lit(seed + 1)), col(key))
    ranked = df.withColumn("batch", batch).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= size)


def review_payload(df: DataFrame, key: str, target: str, context: Sequence[str], **sampling) -> DataFrame:
    """(column_name, batch, payload): sampled rows of a target and its context as a JSON list."""
    sampled = sample_batches(df.select(key, target, *context), key, **sampling)
    record = F.struct(col(target), *[col(c) for c in context])
    listed = F.array_sort(F.collect_list(F.struct(F.col("place"), record.alias("r"))))  # at most `size` rows
    return sampled.groupBy("batch").agg(
        F.to_json(F.transform(listed, lambda s: s["r"])).alias("payload"), F.count("*").alias("n_rows")
    ).select(F.lit(target).alias("column_name"), "batch", "n_rows", "payload")


def reasons_dedup(replies: DataFrame, limit: int = MAX_REASONS) -> DataFrame:
    """First distinct reasons per column, by first appearance.

    ``replies``: column_name, reply_id, reason. Reasons are made distinct and
    ranked before anything is collected, so a column with many replies is safe.
    """
    return _first_distinct(replies, "reason", limit).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]).alias("reasons")
    )


def _first_distinct(replies: DataFrame, name: str, limit: int) -> DataFrame:
    stated = replies.filter(F.col(name).isNotNull() & (F.trim(F.col(name)) != ""))
    first = stated.groupBy("column_name", F.col(name).alias("item")).agg(F.min("reply_id").alias("first_id"))
    order = Window.partitionBy("column_name").orderBy("first_id", "item")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def verdict_counts(replies: DataFrame) -> DataFrame:
    return replies.groupBy("column_name").agg(
        F.count("*").alias("n_replies"),
        F.count_if(F.col("verdict") == "inconsistent").alias("n_inconsistent"),
        F.count_if(F.col("verdict") == "possibly inconsistent").alias("n_possibly"),
    )


def _verdict() -> Column:
    return (
        F.when(F.col("n_inconsistent") > 0, "inconsistent")
        .when(F.col("n_possibly") > 0, "possibly inconsistent")
        .otherwise("consistent")
    )


def verdict_aggregate(replies: DataFrame) -> DataFrame:
    """One finding per column: the strongest verdict wins. Unparsed replies (NULL verdict) are silent.

    ``samples_checked`` adds up ``n_rows``, the rows that a reply's reviewer was shown (see ``review_payload``); a reply
    without it stands for one row.
    """
    shown = F.coalesce(F.col("n_rows"), F.lit(1)) if "n_rows" in replies.columns else F.lit(1)
    looked = replies.groupBy(F.col("column_name").alias("c")).agg(F.sum(shown).cast("long").alias("samples_checked"))
    judged = verdict_counts(replies).withColumn("verdict", _verdict())
    judged = judged.join(looked, judged["column_name"].eqNullSafe(looked["c"]))
    flagged = F.col("verdict") != "consistent"
    return judged.select(
        "column_name",
        F.lit("categorical").alias("type"),
        "n_replies",
        "samples_checked",
        "verdict",
        F.when(flagged, "High").otherwise("Medium").alias("confidence"),
        F.when(flagged, CATEGORY_FLAG).otherwise("").alias("discrepancy_flag"),
    )


def verdict_gate(replies: DataFrame, signals: DataFrame) -> DataFrame:
    """Older rule: an unparsed reply counts as "possibly", and a finding is flagged
    only if the data shows a strong tie (mode share or association above 0.5)."""
    assumed = replies.withColumn("verdict", F.coalesce("verdict", F.lit("possibly inconsistent")))
    judged = verdict_counts(assumed).withColumn("verdict", _verdict())
    joined = judged.join(F.broadcast(signals), "column_name", "left")  # one row per column
    tied = (F.coalesce("avg_mode_share", F.lit(0.0)) > SIGNAL_LIMIT) | (
        F.coalesce("max_cramers_v", F.lit(0.0)) > SIGNAL_LIMIT
    )
    flagged = (F.col("verdict") != "consistent") & tied
    return joined.select(
        "column_name",
        "n_replies",
        "verdict",
        F.lit("Low").alias("confidence"),
        F.coalesce("avg_mode_share", F.lit(0.0)).alias("avg_mode_share"),
        F.coalesce("max_cramers_v", F.lit(0.0)).alias("max_cramers_v"),
        F.when(flagged, CATEGORY_FLAG).otherwise("").alias("discrepancy_flag"),
    )


def numeric_verdict(replies: DataFrame, checked: DataFrame) -> DataFrame:
    """Verdicts valid / suspicious / invalid per numeric column, with the first reasons, example rows and description.

    ``replies``: column_name, verdict, and as far as there are any reply_id, reason, example (a row as text) and
    description, each read in the order of reply_id. ``checked`` gives (column_name, n) of values looked at.
    """
    given = replies
    for name, dtype in (("reply_id", "long"), ("reason", "string"), ("example", "string"), ("description", "string")):
        if name not in given.columns:
            given = given.withColumn(name, F.lit(None).cast(dtype))
    judged = given.groupBy("column_name").agg(
        F.count_if(F.col("verdict") == "invalid").alias("n_invalid"),
        F.count_if(F.col("verdict") == "suspicious").alias("n_suspicious"),
    )
    verdict = (
        F.when(F.col("n_invalid") > 0, "invalid").when(F.col("n_suspicious") > 0, "suspicious").otherwise("valid")
    )
    described = _first_distinct(given, "description", 1).select("column_name", F.col("item").alias("description"))
    joined = checked.join(F.broadcast(judged), "column_name", "left")  # one row per column, as all below
    for part in (reasons_dedup(given), _examples(given, MAX_NUMERIC_EXAMPLES), described):
        joined = joined.join(F.broadcast(part), "column_name", "left")
    nothing = F.array().cast("array<string>")
    return joined.select(
        "column_name",
        F.lit("numeric").alias("type"),
        F.col("n").alias("samples_checked"),
        verdict.alias("verdict"),
        F.lit("High").alias("confidence"),
        F.when(verdict == "valid", "").otherwise(NUMERIC_FLAG).alias("discrepancy_flag"),
        F.coalesce("reasons", nothing).alias("example_reasons"),
        F.coalesce("example_rows", nothing).alias("example_rows"),
        F.coalesce("description", F.lit(NOTHING_FOUND)).alias("description"),
    )


def _examples(replies: DataFrame, limit: int) -> DataFrame:
    """The first example rows per column."""
    order = Window.partitionBy("column_name").orderBy("reply_id", "example")
    ranked = replies.filter(F.col("example").isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", "example")))
    return ranked.groupBy("column_name").agg(F.transform(listed, lambda s: s["example"]).alias("example_rows"))


def findings(replies: DataFrame) -> DataFrame:
    """Verdict, reasons and description of each column in one table.

    ``replies``: column_name, reply_id, verdict, reason, description, example, and n_rows if known.
    """
    described = _first_distinct(replies, "description", MAX_DESCRIPTIONS).groupBy("column_name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]), " | "
        ).alias("description")
    )
    out = verdict_aggregate(replies)
    for part in (reasons_dedup(replies), described, _examples(replies, MAX_EXAMPLES)):
        out = out.join(part, "column_name", "left")
    return out


def semantic_summary(found: DataFrame) -> DataFrame:
    """One line per flagged column of a findings table with ``reasons``."""
    flagged = found.filter(F.col("discrepancy_flag") != "")
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("- **"), F.col("column_name"), F.lit("**: "), F.col("discrepancy_flag")),
        F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), "; "),
    )
    return flagged.select("column_name", line.alias("line"))
