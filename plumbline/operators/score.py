"""Quality scores and grades, the full column profile, and reports over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, half_up, numeric_long, of_kind, share
from plumbline.operators import stats
from plumbline.operators.drift import psi_profile
from plumbline.operators.ordering import numeric_cuts, with_range
from plumbline.operators.outliers import approx_rates, forest_rates, rates_from_counts, zscore_rates
from plumbline.operators.reshape import membership_rate, references_by_name

# Weights of the column score.
WEIGHTS = {
    "completeness": 0.25,
    "placeholder": 0.15,
    "validity": 0.15,
    "format": 0.10,
    "outliers": 0.10,
    "drift": 0.10,
    "uniqueness": 0.15,
}
# Grade limits, shared by the ordinary and the datetime grades.
GRADE_LIMITS = [90, 75, 60]
GRADES = ["Excellent", "Good", "Moderate", "Poor"]
DATETIME_GRADES = ["Fresh & Valid", "Valid but Slightly Stale", "Old / Semi-Valid", "Invalid / Corrupted"]


def clip_score(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))


def graded(score: Column, labels: Sequence[str]) -> Column:
    chain = F.when(score >= GRADE_LIMITS[0], labels[0])
    for limit, label in zip(GRADE_LIMITS[1:], labels[1:]):
        chain = chain.when(score >= limit, label)
    return chain.otherwise(labels[3])


def column_score() -> Column:
    """Weighted score of an ordinary column, over a profile row of rates."""
    outlier_mean = (F.col("outlier_z") + F.col("outlier_iqr") + F.col("outlier_iso")) / 3
    valid = stats.validity(
        F.col("dtype_conformity"), F.col("format_consistency"), F.col("range_conformity"), F.col("referential_integrity")
    )
    total = (
        WEIGHTS["completeness"] * F.col("completeness")
        + WEIGHTS["placeholder"] * (1 - F.col("placeholder_ratio"))
        + WEIGHTS["validity"] * valid
        + WEIGHTS["format"] * F.col("format_consistency")
        + WEIGHTS["outliers"] * (1 - outlier_mean)
        + WEIGHTS["drift"] * (1 - F.coalesce(F.col("drift_psi"), F.lit(0.0)))
        + WEIGHTS["uniqueness"] * F.col("uniqueness")
    )
    return clip_score(100 * total)


# ------------------------------------------------------------------- datetimes
def monotone_order(df: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """(column_name, ordered): do the non-missing datetimes only rise or only fall
    in the order of the unique, numeric load-order column?

    Neighbours are compared inside ranges of the order column; the first and last
    value of each range (a bounded table) settle the seams.
    """
    # positions for names: a data column may be called like a helper; the order column keeps its type
    places = [f"c{i}" for i in range(len(names))]
    values = df.select(*[stats.as_datetime(df.schema[n]).alias(p) for n, p in zip(names, places)], col(order).alias("value"))
    cuts = numeric_cuts(df.select(F.lit("order").alias("column_name"), col(order).cast("double").alias("value")))
    ranged = with_range(values.withColumn("column_name", F.lit("order")), cuts).drop("column_name")
    long = ranged.unpivot(["value", "range_id"], places, "column_name", "moment").filter(F.col("moment").isNotNull())
    back = F.create_map(*[F.lit(x) for pair in zip(places, names) for x in pair])
    long = long.withColumn("column_name", back[F.col("column_name")])
    inside = Window.partitionBy("column_name", "range_id").orderBy("value")
    stepped = long.withColumn("previous", F.lag("moment").over(inside))
    per_range = stepped.groupBy("column_name", "range_id").agg(
        F.min_by("moment", "value").alias("first"),
        F.max_by("moment", "value").alias("last"),
        F.coalesce(F.bool_or(F.col("moment") < F.col("previous")), F.lit(False)).alias("falls"),
        F.coalesce(F.bool_or(F.col("moment") > F.col("previous")), F.lit(False)).alias("rises"),
    )
    seams = Window.partitionBy("column_name").orderBy("range_id")
    before = F.lag("last").over(seams)
    joined = per_range.select(
        "column_name",
        (F.col("falls") | F.coalesce(F.col("first") < before, F.lit(False))).alias("falls"),
        (F.col("rises") | F.coalesce(F.col("first") > before, F.lit(False))).alias("rises"),
    )
    return joined.groupBy("column_name").agg(
        (~F.bool_or("falls") | ~F.bool_or("rises")).alias("ordered")
    )


def datetime_score(as_of: str, variant: str = "v2") -> Column:
    """Over a row with n, parsed, min_time, max_time, ordered. NULL where nothing parses."""
    fresh = stats.whole_days(as_of, F.col("max_time"))
    if variant == "v1":
        aged = F.when((fresh != 0) & (fresh < 365), fresh / F.lit(365.0)).otherwise(1.0)
    else:
        aged = F.when(fresh >= 0, fresh / F.lit(365.0)).otherwise(1.0)
    five_days_on = stats.ntz(as_of) + F.expr("INTERVAL 5 DAYS")
    parts = (
        share(F.col("parsed"), F.col("n"))
        + (1 - aged)
        + F.when(F.col("min_time") > stats.ntz("1900-01-01 00:00:00"), 1.0).otherwise(0.0)
        + F.when(F.col("max_time") < five_days_on, 1.0).otherwise(0.0)
        + F.when(F.coalesce(F.col("ordered"), F.lit(False)), 1.0).otherwise(0.8)
    )
    return F.when(F.col("parsed") > 0, clip_score(100 * parts / 5))


def datetime_quality(
    df: DataFrame, names: Sequence[str], order: str | None, as_of: str, variant: str = "v2"
) -> DataFrame:
    base = stats.column_stats(df, names, parse=True)
    if order is not None:
        base = base.join(F.broadcast(monotone_order(df, names, order)), "column_name", "left")
    else:
        base = base.withColumn("ordered", F.lit(None).cast("boolean"))
    scored = base.withColumn("quality", datetime_score(as_of, variant))
    return scored.select(
        "column_name",
        "n",
        "parsed",
        "ordered",
        F.coalesce("quality", F.lit(0.0)).alias("dq_score"),
        datetime_grade(F.col("quality")).alias("dq_grade"),
    )


def datetime_grade(quality: Column) -> Column:
    return F.when(quality.isNull(), "Invalid Datetime").otherwise(graded(quality, DATETIME_GRADES))


# ----------------------------------------------------------------- full profile
def exact_rates(
    df: DataFrame, numeric: Sequence[str], base: DataFrame, typed: dict[str, DataFrame]
) -> DataFrame:
    """Outlier rates from the value counts and the moments the profile has anyway.
    Decimals are counted as text there, so they are counted again as numbers here."""
    decimals = [n for n in numeric if df.schema[n].dataType.typeName() == "decimal"]
    parts = [stats.numeric_counts(typed)] if len(decimals) < len(numeric) else []
    if decimals:
        parts.append(numeric_long(df, decimals).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    moments = base.select("column_name", F.col("non_null").alias("n"), "mean", "std_pop")
    return rates_from_counts(counts, moments, numeric_cuts(numeric_long(df, numeric)))


def profile(
    df: DataFrame,
    *,
    as_of: str,
    order: str | None = None,
    baseline: DataFrame | None = None,
    references: dict[str, tuple[DataFrame, str]] | None = None,
    reference_tables: dict[str, DataFrame] | None = None,
    forest_key: str | None = None,
    approx: bool = False,
    rounded: bool = True,
) -> DataFrame:
    """The main quality profile, one row per column.

    ``order`` names the unique load-order column for the datetime ordering test;
    ``references`` maps a column to (table, key column), ``reference_tables`` finds
    them by name (see ``references_by_name``); ``forest_key`` names the row key that drives the isolation forest (left out: that rate is 0);
    ``approx`` swaps exact distinct counts and quartiles for sketches.
    """
    names = [*df.columns]
    references = references_by_name(names, reference_tables or {}) | (references or {})
    numeric = of_kind(df, "numeric")
    base = stats.column_stats(df, names, parse=True)
    typed = {} if approx else stats.typed_counts(df, names)
    table = stats._with_distinct(df, names, approx, base=base, typed=typed)

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "column_name", "left")  # one row per column

    if numeric:
        table = attach(table, approx_rates(numeric_long(df, numeric)) if approx else exact_rates(df, numeric, base, typed))
        if forest_key is not None:
            table = attach(table, forest_rates(df, numeric, forest_key).select("column_name", "outlier_iso"))
    shared = [n for n in numeric if baseline is not None and n in baseline.columns]
    if shared:
        table = attach(table, psi_profile(baseline, df, shared).withColumnRenamed("psi_profile", "drift_psi"))
    for name, (reference, key) in references.items():
        rate = membership_rate(df, name, reference, key).select(
            F.lit(name).alias("column_name"), F.col("rate").alias(f"ref_{name}")
        )
        table = attach(table, rate)
    found = [F.col(f"`ref_{n}`") for n in references]
    table = table.withColumn(
        "referential_integrity", F.coalesce(*found) if found else F.lit(None).cast("double")
    )
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    moments = [*of_kind(df, "datetime"), *texts]
    if order is not None and moments:
        table = attach(table, monotone_order(df, moments, order))
    defaults = {"outlier_z": "0D", "outlier_iqr": "0D", "outlier_iso": "0D"}
    optional = {"drift_psi": "CAST(NULL AS DOUBLE)", "ordered": "CAST(NULL AS BOOLEAN)"}
    have = set(table.columns)
    filled = {n: F.expr(f"coalesce({n}, {d})" if n in have else d) for n, d in defaults.items()}
    filled |= {n: F.expr(d) for n, d in optional.items() if n not in have}
    table = table.withColumns(filled)

    zero = F.lit(0.0)
    rates = table.select(
        "*",
        F.coalesce(share(F.col("non_null"), F.col("n")), zero).alias("completeness"),
        F.coalesce(share(F.col("placeholders"), F.col("non_null")), zero).alias("placeholder_ratio"),
        F.coalesce(share(F.col("n_unique"), F.col("n")), zero).alias("uniqueness"),
        F.coalesce(share(F.col("formatted"), F.col("non_null")), F.lit(1.0)).alias("format_consistency"),
        F.lit(1.0).alias("range_conformity"),
        F.when(F.col("kind") == "datetime", F.coalesce(share(F.col("non_null"), F.col("n")), F.lit(1.0)))
        .otherwise(F.lit(1.0))
        .alias("dtype_conformity"),
        stats.detect_id_v2().alias("is_id"),
        stats.detect_datetime().alias("is_datetime"),
        datetime_score(as_of).alias("moment_score"),
    )
    scored = rates.withColumn(
        "dq_score",
        F.when(F.col("is_id"), 100.0)
        .when(F.col("is_datetime"), F.coalesce("moment_score", zero))
        .otherwise(column_score()),
    ).withColumn(
        "dq_grade",
        F.when(F.col("is_id"), "Identifier")
        .when(F.col("is_datetime"), datetime_grade(F.col("moment_score")))
        .otherwise(graded(F.col("dq_score"), GRADES)),
    )

    def shown(name: str, digits: int, factor: float = 1.0) -> Column:
        c = F.col(name) * factor if factor != 1.0 else F.col(name)
        return half_up(c, digits) if rounded else c

    return scored.select(
        "position",
        "column_name",
        "type",
        "kind",
        "is_id",
        "is_datetime",
        shown("completeness", 3).alias("completeness"),
        shown("placeholder_ratio", 2, 100.0).alias("placeholder_pct"),
        shown("uniqueness", 3).alias("uniqueness"),
        shown("entropy", 3).alias("entropy"),
        shown("format_consistency", 3).alias("format_consistency"),
        shown("range_conformity", 3).alias("range_conformity"),
        shown("referential_integrity", 3).alias("referential_integrity"),
        shown("outlier_z", 2, 100.0).alias("outlier_z_pct"),
        shown("outlier_iqr", 2, 100.0).alias("outlier_iqr_pct"),
        shown("outlier_iso", 2, 100.0).alias("outlier_iso_pct"),
        shown("drift_psi", 4).alias("drift_psi"),
        shown("dq_score", 2).alias("dq_score"),
        "dq_grade",
        (half_up(100 * (1 - F.col("completeness")), 2) if rounded else 100 * (1 - F.col("completeness"))).alias(
            "missing_pct"
        ),
        (half_up(100 * (1 - F.col("uniqueness")), 2) if rounded else 100 * (1 - F.col("uniqueness"))).alias(
            "duplicate_pct"
        ),
        "n_unique",
        "n",
        "min",
        "max",
    )


# ------------------------------------------------------------- first-version score
def score_v1(df: DataFrame, forest_key: str | None = None) -> DataFrame:
    """100 less 15 for each of null > 10 %, uniqueness < 50 %, outliers > 5 %; 5 back for an ID."""
    numeric = of_kind(df, "numeric")
    table = stats._with_distinct(df, None)
    if numeric:
        rates = zscore_rates(df, numeric).select("column_name", "outlier_z")
        table = table.join(F.broadcast(rates), "column_name", "left")
        if forest_key is not None:
            iso = forest_rates(df, numeric, forest_key, contamination=0.05).select("column_name", "outlier_iso")
            table = table.join(F.broadcast(iso), "column_name", "left")
    for c in ("outlier_z", "outlier_iso"):
        table = table.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) if c in table.columns else F.lit(0.0))
    null_pct = stats.missing_pct()
    unique_pct = F.coalesce(100 * share(F.col("n_unique"), F.col("n")), F.lit(0.0))
    outlier_pct = 100 * F.greatest("outlier_z", "outlier_iso")
    named = table.select(
        "position",
        "column_name",
        "type",
        "kind",
        null_pct.alias("null_pct"),
        F.col("n_unique").alias("unique_count"),
        unique_pct.alias("uniqueness_pct"),
        outlier_pct.alias("outlier_pct"),
        F.coalesce(stats.detect_id_v1(), F.lit(False)).alias("is_id"),
        "min",
        "max",
        "max_time",
    )
    points = (
        F.lit(100.0)
        - F.when(F.col("null_pct") > 10, 15.0).otherwise(0.0)
        - F.when(F.col("uniqueness_pct") < 50, 15.0).otherwise(0.0)
        - F.when(F.col("outlier_pct") > 5, 15.0).otherwise(0.0)
        + F.when(F.col("is_id"), 5.0).otherwise(0.0)
    )
    return named.withColumn("dq_score", clip_score(points))


# ---------------------------------------------------------- reports over a profile
def dataset_score(profiled: DataFrame) -> DataFrame:
    return profiled.agg(F.avg("dq_score").alias("dataset_score"), F.count("*").alias("n_columns"))


def bad_columns(profiled: DataFrame, below: float = 60) -> DataFrame:
    return profiled.filter(F.col("dq_score") < below).select("column_name", "dq_score")


def issue_text() -> Column:
    """Issues by fixed limits, over a profile row."""
    found = [
        F.when(F.col("missing_pct") > 10, "missing values"),
        F.when(F.col("placeholder_pct") > 5, "placeholder values"),
        F.when(F.col("format_consistency") < 0.95, "format errors"),
        F.when(F.greatest("outlier_z_pct", "outlier_iqr_pct", "outlier_iso_pct") > 5, "outliers"),
        F.when(F.col("referential_integrity") < 1, "dangling references"),
        F.when(F.col("drift_psi") > 0.2, "drift"),
    ]
    joined = F.concat_ws("; ", *found)
    return F.when(joined == "", "No major issues").otherwise(joined)


def score_ranking(profiled: DataFrame) -> DataFrame:
    """Lowest score first. One row per column, so the ranking window is small."""
    order = Window.partitionBy().orderBy("dq_score", "position")
    return profiled.select(
        F.row_number().over(order).alias("place"), "column_name", "dq_score", issue_text().alias("issues")
    )


def quality_report(profiled: DataFrame) -> DataFrame:
    """Sections: weak columns, identifiers, datetimes, and the three largest dataset issues."""

    def section(name: str, rows: DataFrame, detail: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.col("column_name").alias("item"), detail.alias("detail"))

    weak = section(
        "weak", profiled.filter(F.col("dq_grade").isin("Moderate", "Poor")), F.concat_ws(": ", "dq_grade", issue_text())
    )
    ids = section("identifier", profiled.filter("is_id"), F.col("dq_grade"))
    moments = section("datetime", profiled.filter("is_datetime AND NOT is_id"), F.col("dq_grade"))
    outlier = F.greatest("outlier_z_pct", "outlier_iqr_pct", "outlier_iso_pct")
    measures = profiled.agg(
        F.avg("missing_pct").alias("missingness"),
        F.avg(outlier).alias("outliers"),
        F.avg(100 * F.coalesce("drift_psi", F.lit(0.0))).alias("drift"),
        F.avg("placeholder_pct").alias("placeholders"),
    ).unpivot([], ["missingness", "outliers", "drift", "placeholders"], "item", "size")
    largest = measures.orderBy(F.desc("size"), "item").limit(3)
    issues = largest.select(
        F.lit("issue").alias("section"), "item", half_up(F.col("size"), 4).cast("decimal(18,4)").cast("string").alias("detail")
    )
    return weak.unionByName(ids).unionByName(moments).unionByName(issues)
