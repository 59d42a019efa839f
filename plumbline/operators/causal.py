"""Adjusted treatment effects: exact strata and propensity-score matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import replicates as replicated
from plumbline.functions.columns import as_double, col, kind, share
from plumbline.functions.fit_tests import chi2_p_value
from plumbline.operators.ordering import numeric_cuts, running_totals, text_cuts, with_range

REPLICATES = 100
NORMAL_95 = 1.959963984540054
BROADCAST_CODES = 1 << 24  # bytes of a column's category codes that are sent to all tasks
SPREAD = 64


def category_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): position of each distinct text in sorted order, from 0."""
    values = df.select(col(name).cast("string").alias("value")).filter(F.col("value").isNotNull())
    distinct = values.groupBy("value").agg(F.lit(1).cast("bigint").alias("n")).withColumn("all", F.lit(0))
    ranked = running_totals(distinct, ["all"], ["n"], text_cuts(values, "value"))
    return ranked.select("value", (F.col("cum_n") - 1).alias("code"))


def with_codes(df: DataFrame, complete: DataFrame, name: str) -> DataFrame:
    """The text column ``name`` of ``df`` as its category code among the values of ``complete``.

    Few codes are sent to all tasks, and the rows stay where they are. Else rows meet their code by value; those of a
    frequent value are dealt to SPREAD parts by a hash of the whole row, each with a copy of the code, so that no task
    gets all rows of a value.
    """
    text, codes = col(name).cast("string"), category_codes(complete, name).select(F.col("value").alias("_v"), F.col("code").cast("double").alias("_c"))
    sizes = complete.agg(F.approx_count_distinct(text), F.max(F.octet_length(text)), F.count("*")).first()
    if sizes[0] * ((sizes[1] or 0) + 16) <= BROADCAST_CODES:
        joined = df.join(F.broadcast(codes), text == F.col("_v"), "left")
    else:
        counts = complete.groupBy(F.xxhash64(text).alias("h")).agg(F.count("*").alias("n"))
        frequent = [r["h"] for r in counts.filter(F.col("n") > sizes[2] / (16 * SPREAD)).collect()]  # fewer than 16 * SPREAD
        row = F.xxhash64(*[col(f.name) for f in df.schema if kind(f.dataType) != "nested"])
        part = F.when(F.xxhash64(text).isin(frequent), F.pmod(row, F.lit(SPREAD))).otherwise(0)
        parts = F.when(F.xxhash64("_v").isin(frequent), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        codes = codes.withColumn("_p", F.explode(parts))
        joined = df.join(codes, (text == F.col("_v")) & (part == F.col("_p")), "left").drop("_p")
    return joined.withColumn(name, F.col("_c")).drop("_v", "_c")


def causal_prepare(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], key: str) -> DataFrame:
    """Key plus numeric columns only: missing rows dropped, datetimes as whole days
    since their first, texts as category codes."""
    names = [treatment, outcome, *confounders]
    absent = [n for n in [*names, key] if n not in df.columns]
    if absent:
        raise ValueError(f"unknown columns: {absent}")
    complete = df.select(key, *dict.fromkeys(names))
    for n in dict.fromkeys(names):
        field = df.schema[n]
        complete = complete.filter((as_double(field) if kind(field.dataType) == "numeric" else col(n)).isNotNull())
    prepared = complete
    for n in dict.fromkeys(names):
        field = df.schema[n]
        k = kind(field.dataType)
        if k == "numeric":
            prepared = prepared.withColumn(n, col(n).cast("double"))
        elif k == "datetime":
            first = complete.agg(F.min(col(n)).alias("m")).select("m").scalar()
            seconds = F.unix_seconds(col(n).cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))
            prepared = prepared.withColumn(n, F.floor(seconds / 86400.0).cast("double"))
        elif k == "text":
            prepared = with_codes(prepared, complete, n)
        else:
            prepared = prepared.drop(n)
    return prepared


def derived_change(df: DataFrame, before: str, after: str, name: str) -> DataFrame:
    return df.withColumn(name, col(after) - col(before))


# ---------------------------------------------------------------------- exact strata
def stratum_sums(df: DataFrame, treatment: str, outcome: str, strata: Sequence[str]) -> DataFrame:
    t, y = col(treatment), col(outcome).cast("double")
    return df.groupBy(*[col(s) for s in strata]).agg(
        F.count_if(t == 1).alias("n1"),
        F.count_if(t == 0).alias("n0"),
        F.sum(F.when(t == 1, y)).alias("y1"),
        F.sum(F.when(t == 0, y)).alias("y0"),
        F.var_samp(F.when(t == 1, y)).alias("v1"),
        F.var_samp(F.when(t == 0, y)).alias("v0"),
    )


def ate_stratified(df: DataFrame, treatment: str, outcome: str, strata: Sequence[str]) -> DataFrame:
    """Sum over strata of P(s) times the mean difference, over strata with both arms,
    with a normal 95 % interval from the strata's variances."""
    both = stratum_sums(df, treatment, outcome, strata).filter((F.col("n1") > 0) & (F.col("n0") > 0))
    rows = (F.col("n1") + F.col("n0")).cast("double")
    gap = F.col("y1") / F.col("n1") - F.col("y0") / F.col("n0")
    spread = F.coalesce("v1", F.lit(0.0)) / F.col("n1") + F.coalesce("v0", F.lit(0.0)) / F.col("n0")
    summed = both.agg(
        F.sum(rows).alias("n"), F.sum(rows * gap).alias("g"), F.sum(rows * rows * spread).alias("v"), F.count("*").alias("strata")
    )
    ate = share(F.col("g"), F.col("n"))
    error = share(F.sqrt("v"), F.col("n"))
    return summed.select(
        F.lit(treatment).alias("treatment"),
        F.lit(outcome).alias("outcome"),
        ate.alias("ate"),
        (ate - NORMAL_95 * error).alias("ci_low"),
        (ate + NORMAL_95 * error).alias("ci_high"),
        F.col("n").cast("bigint").alias("rows_used"),
        "strata",
    )


def ate_interval(
    df: DataFrame, key: str, treatment: str, outcome: str, strata: Sequence[str], replicates: int = REPLICATES, seed: int = 7
) -> DataFrame:
    """Bootstrap 95 % interval of the stratified effect.

    Every row gets a Poisson(1) weight per replicate from a hash of its key, so a retry or another partitioning draws
    the same weights; rows of one key are drawn together. Tasks add up arrays of weighted counts and outcomes per
    stratum; only these arrays are shuffled. Replicates in which no stratum has both arms are left out.
    """
    t = col(treatment)
    rows = df.select(
        F.to_json(F.struct(*[col(s).alias(f"s{i}") for i, s in enumerate(strata)]), {"ignoreNullFields": "false"}).alias("stratum"),
        F.when(t == 1, 1).when(t == 0, 0).otherwise(-1).alias("treated"),
        col(outcome).cast("double").alias("outcome"),
        F.xxhash64(col(key), F.lit(seed)).alias("lot"),
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.mapInArrow(lambda batches: replicated.fill(batches, replicates), replicated.SUMS)
    ordered = sums.repartition(tasks, "stratum").sortWithinPartitions("stratum")
    parts = ordered.mapInArrow(lambda batches: replicated.effects(batches, replicates), replicated.EFFECTS)
    points = parts.repartition(1).mapInArrow(lambda batches: replicated.interval(batches, replicates), "ci_low double, ate_median double, ci_high double, replicates long")
    return points


# ------------------------------------------------------------------ score matching
def propensity_scores(prepared: DataFrame, treatment: str, confounders: Sequence[str]) -> DataFrame:
    """Add ``score`` = P(treated | confounders) from logistic regression."""
    features = VectorAssembler(inputCols=list(confounders), outputCol="_x", handleInvalid="error")
    assembled = features.transform(prepared)
    model = LogisticRegression(featuresCol="_x", labelCol=treatment, regParam=0.0, maxIter=50, tol=1e-8).fit(assembled)
    scored = model.transform(assembled)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def ate_matched(
    scored: DataFrame, treatment: str, outcome: str, key: str, score: str = "score", ties: str = "mean"
) -> DataFrame:
    """Nearest neighbour of each row in the other arm, with replacement, both ways.

    Rows of equal score are folded first: counts, outcome sums and what the arm
    offers as a match - the mean of its rows at that score, or with
    ``ties="first"`` the row of the lowest key. Neighbours are then the nearest
    filled score on either side, looked up inside score ranges with the ends of
    the ranges carried over. A tie in distance goes to the lower score.

    ``std_error`` is that of a matching estimator with replacement: the spread of the rows' effects, and for every row
    its outcome's variance times K^2 + 2 K - K / m, where K is how often the row serves as a match and m the number of
    rows that share a match with it (both directions are counted from the neighbours found). The variance comes from the
    rows of the arm at that score, or for a lone row from the nearest score of its arm.
    """
    if ties not in ("mean", "first"):
        raise ValueError(f"unknown ties {ties!r}")

    def offer(value: Column, wanted: Column) -> Column:
        if ties == "mean":
            return F.avg(F.when(wanted, value))
        return F.min_by(value, F.when(wanted, col(key)))

    t, y = col(treatment) == 1, col(outcome).cast("double")
    folded = scored.groupBy(col(score).alias("value")).agg(
        F.count_if(t).alias("n1"),
        F.count_if(~t).alias("n0"),
        F.coalesce(F.sum(F.when(t, y)), F.lit(0.0)).alias("y1"),
        F.coalesce(F.sum(F.when(~t, y)), F.lit(0.0)).alias("y0"),
        offer(y, t).alias("r1"),
        offer(y, ~t).alias("r0"),
        F.coalesce(F.sum(F.when(t, y * y)), F.lit(0.0)).alias("q1"),
        F.coalesce(F.sum(F.when(~t, y * y)), F.lit(0.0)).alias("q0"),
        F.var_samp(F.when(t, y)).alias("v1"),
        F.var_samp(F.when(~t, y)).alias("v0"),
    )
    cuts = numeric_cuts(scored.select(F.lit("score").alias("column_name"), col(score).alias("value")))
    ranged = with_range(folded.withColumn("column_name", F.lit("score")), cuts).drop("column_name")
    for arm in ("1", "0"):
        here = F.when(F.col(f"n{arm}") > 0, F.struct(F.col("value").alias("s"), F.col(f"r{arm}").alias("r"), (F.col(f"y{arm}") / F.col(f"n{arm}")).alias("mean"), F.col(f"n{arm}").alias("n")))
        ranged = ranged.withColumn(f"p{arm}", here)
    ends = ranged.groupBy("range_id").agg(
        *[F.max_by(f"p{a}", F.when(F.col(f"n{a}") > 0, F.col("value"))).alias(f"last{a}") for a in "10"],
        *[F.min_by(f"p{a}", F.when(F.col(f"n{a}") > 0, F.col("value"))).alias(f"first{a}") for a in "10"],
    )
    # frames run forwards only: a frame that starts at the current row and is open
    # at its end is recomputed for every row, so the upper side is read backwards
    up, down = Window.partitionBy().orderBy("range_id"), Window.partitionBy().orderBy(F.desc("range_id"))
    past = (Window.unboundedPreceding, -1)  # over one row per range, a few thousand at most
    carried = ends.select(
        "range_id",
        *[F.last(f"last{a}", True).over(up.rowsBetween(*past)).alias(f"before{a}") for a in "10"],
        *[F.last(f"first{a}", True).over(down.rowsBetween(*past)).alias(f"after{a}") for a in "10"],
    )
    inside = Window.partitionBy("range_id")
    so_far = (Window.unboundedPreceding, 0)
    rising = inside.orderBy("value").rowsBetween(*so_far)
    falling = inside.orderBy(F.desc("value")).rowsBetween(*so_far)
    near = ranged.join(F.broadcast(carried), "range_id")
    for a in "10":
        near = near.withColumn(f"low{a}", F.coalesce(F.last(f"p{a}", True).over(rising), F.col(f"before{a}")))
    for a in "10":
        near = near.withColumn(f"high{a}", F.coalesce(F.last(f"p{a}", True).over(falling), F.col(f"after{a}")))
    for a in "10":
        low, high = F.col(f"low{a}"), F.col(f"high{a}")
        closer = (F.col("value") - low["s"]) <= (high["s"] - F.col("value"))
        near = near.withColumn(f"picked{a}", F.when(high.isNull() | (low.isNotNull() & closer), low).otherwise(high))
    # The nearest other score of the same arm, for the variance of a lone row.
    for a in "10":
        below = F.coalesce(F.last(f"p{a}", True).over(rising.rowsBetween(*past)), F.col(f"before{a}"))
        near = near.withColumn(f"below{a}", below)
    for a in "10":
        above = F.coalesce(F.last(f"p{a}", True).over(falling.rowsBetween(*past)), F.col(f"after{a}"))
        near = near.withColumn(f"above{a}", above)
    # How often the rows at a score serve: every picked score counts the rows that picked it.
    taken = near.select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"picked{a}")["s"].alias("score"), F.col(f"n{b}").alias("times")) for a, b in ("10", "01")])))
    used = taken.filter("times > 0 AND score IS NOT NULL").groupBy("score").agg(
        *[F.coalesce(F.sum(F.when(F.col("arm") == a, F.col("times"))), F.lit(0)).alias(f"used{a}") for a in "10"]
    )
    whole = near.join(used, near["value"] == used["score"], "left")
    match1, match0 = F.col("picked1")["r"], F.col("picked0")["r"]
    effect = (F.col("y1") - F.col("n1") * match0) + (F.col("n0") * match1 - F.col("y0"))
    # Written so that an arm without rows here adds 0, whatever its match is.
    zero = F.lit(0.0)
    squares1 = F.when(F.col("n1") > 0, F.col("q1") - 2 * F.col("y1") * match0 + F.col("n1") * match0 * match0).otherwise(zero)
    squares0 = F.when(F.col("n0") > 0, F.col("q0") - 2 * F.col("y0") * match1 + F.col("n0") * match1 * match1).otherwise(zero)
    noise = zero
    for a in "10":
        n, times, own = F.col(f"n{a}").cast("double"), F.coalesce(F.col(f"used{a}"), F.lit(0)).cast("double"), F.col("value")
        lower, upper = F.col(f"below{a}"), F.col(f"above{a}")
        beside = F.when(upper.isNull() | (lower.isNotNull() & (own - lower["s"] <= upper["s"] - own)), lower).otherwise(upper)
        alone = beside["n"] / (beside["n"] + 1) * (F.col(f"y{a}") - beside["mean"]) ** 2
        variance = F.coalesce(F.when(n > 1, F.col(f"v{a}")).otherwise(alone), zero)
        if ties == "mean":  # each of the n rows serves times / n times, together with the n - 1 others
            each = times / F.nullif(n, zero)
            weight = n * (each * each + 2 * each) - each
        else:  # the row of the lowest key serves alone
            weight = times * times + times
        noise = noise + F.when(n > 0, variance * weight).otherwise(zero)
    summed = whole.agg(
        F.sum(F.coalesce(effect, zero)).alias("g"), F.sum(F.col("n1") + F.col("n0")).alias("n"),
        F.sum("n1").alias("treated"), F.sum("n0").alias("controls"), F.sum(squares1 + squares0).alias("squares"), F.sum(noise).alias("noise"),
    )
    both = (F.col("treated") > 0) & (F.col("controls") > 0)
    n = F.col("n").cast("double")
    ate = F.when(both, share(F.col("g"), F.col("n")))
    spread = F.greatest(F.col("squares") - n * ate * ate, zero)
    return summed.select(
        ate.alias("ate"),
        F.col("n").alias("rows_used"),
        "treated",
        "controls",
        F.when(both, F.sqrt(spread + F.col("noise")) / n).alias("std_error"),
    )


def conversions(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """The columns that ``causal_prepare`` turns into numbers, datetimes first, and those it drops."""
    kinds = {n: kind(df.schema[n].dataType) for n in dict.fromkeys(names)}
    converted = [n for k in ("datetime", "text") for n in kinds if kinds[n] == k]
    return converted, [n for n in kinds if kinds[n] == "nested"]


def ate_psm(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], key: str) -> DataFrame:
    """The matched effect as a record: the effect with its 95 % interval and two-sided p-value (normal), the rows used,
    and what was done to the columns."""
    if not confounders:
        raise ValueError("at least one confounder is needed")
    prepared = causal_prepare(df, treatment, outcome, confounders, key)
    converted, dropped = conversions(df, [treatment, outcome, *confounders])
    if gone := {treatment, outcome} & set(dropped):
        raise ValueError(f"not a number: {sorted(gone)}")
    scored = propensity_scores(prepared, treatment, [c for c in confounders if c not in dropped])
    ate, error = F.col("ate"), F.col("std_error")
    z2 = (ate / F.nullif(error, F.lit(0.0))) ** 2
    return ate_matched(scored, treatment, outcome, key).select(
        F.lit(treatment).alias("treatment"),
        F.lit(outcome).alias("outcome"),
        F.lit(", ".join(confounders)).alias("confounders"),
        "ate",
        (ate - NORMAL_95 * error).alias("ci_low"),
        (ate + NORMAL_95 * error).alias("ci_high"),
        chi2_p_value(z2, F.lit(1)).alias("p_value"),  # of the squared z-score: one degree of freedom
        "rows_used",
        "treated",
        "controls",
        F.lit(", ".join(converted)).alias("converted_columns"),
        F.lit(", ".join(dropped)).alias("dropped_columns"),
    )
