"""Replies, review folding, treatment effects, chart data, SQL views, sources."""

import datetime as dt
import math
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plumbline.operators.ordering as ordering
from plumbline.functions import replicates
from plumbline.operators import causal, chartdata, replies, reshape, review
from plumbline.operators.drift import split_by_filter
from plumbline.operators.sqlview import run_sql
from plumbline.plans import QUERIES, runner
from plumbline.sources.scratch import scratch_path
from plumbline.sources.tables import scan_csv, scan_parquet, sink_csv, sink_parquet

RNG = np.random.default_rng(8)


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "CUT_SAMPLE", 1.0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)


# --------------------------------------------------------------------- replies
def test_reply_forms(spark):
    texts = [
        '{"verdict":"consistent","reason":"a"}',
        '```json\n{"verdict":"inconsistent","reason":"b {x}"}\n```',
        'Sure! {"verdict":"possibly inconsistent","reason":"c"} Anything else?',
        "nothing", "", None, "[1, 2]", '{"verdict": ',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", replies.parse_json(F.col("t"), "verdict string, reason string")["verdict"].alias("v")).collect()}
    assert got == {0: "consistent", 1: "inconsistent", 2: "possibly inconsistent", 3: None, 4: None, 5: None, 6: None, 7: None}
    fenced = spark.createDataFrame([("```sql\nSELECT 1\n```",)], "t string")
    assert fenced.select(replies.strip_fence(F.col("t"))).first()[0] == "SELECT 1"


def test_column_lists(spark):
    texts = ["text\nCOLUMNS=[a, 'b', \"c\"]\nmore", "Columns: [x], y ,", "none", "COLUMNS = [ ]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(replies.column_list(F.col("t"))).collect()] == [["a", "b", "c"], ["x", "y"], [], []]


# ---------------------------------------------------------------------- review
REPLIES = "column_name string, reply_id int, verdict string, reason string, description string, example string"


def test_findings(spark):
    rows = [("a", i, "consistent", None, "d", None) for i in range(5)]
    rows += [("b", i, ["consistent", "possibly inconsistent", None][i % 3], f"r{i % 7}", f"d{i % 4}", f"e{i}") for i in range(300)]
    rows += [("c", 1, "possibly inconsistent", "x", None, None), ("c", 0, "inconsistent", " ", None, None)]
    df = spark.createDataFrame(rows, REPLIES)
    got = {r["column_name"]: r for r in review.findings(df).collect()}
    assert [got[c]["verdict"] for c in "abc"] == ["consistent", "possibly inconsistent", "inconsistent"]
    assert got["b"]["reasons"] == ["r0", "r1", "r2", "r3", "r4"] and got["b"]["description"] == "d0 | d1 | d2"
    assert got["b"]["example_rows"] == ["e0", "e1", "e2"] and got["c"]["reasons"] == ["x"] and got["a"]["reasons"] is None
    lines = {r["column_name"]: r["line"] for r in review.semantic_summary(review.findings(df)).collect()}
    assert set(lines) == {"b", "c"} and lines["c"] == "- **c**: Classification might be wrong | x"
    signals = spark.createDataFrame([("b", 0.4, 0.2), ("c", 0.6, 0.1), ("a", 0.9, 0.9)], "column_name string, avg_mode_share double, max_cramers_v double")
    gate = {r["column_name"]: r["discrepancy_flag"] != "" for r in review.verdict_gate(df, signals).collect()}
    assert gate == {"a": False, "b": False, "c": True}
    unparsed = spark.createDataFrame([("z", 0, None, None, None, None)], REPLIES)
    assert review.verdict_gate(unparsed, signals).first()["verdict"] == "possibly inconsistent"
    assert review.verdict_aggregate(unparsed).first()["verdict"] == "consistent"
    assert review.semantic_summary(review.findings(df.limit(0))).count() == 0


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = review.sample_batches(df, "k").collect()
    assert len(first) == 50 and {r["batch"] for r in first} == set(range(5))
    assert {r["k"] for r in review.sample_batches(df.repartition(9), "k").collect()} == {r["k"] for r in first}
    assert review.sample_cap(df, "k", 10).count() == 10 and review.sample_cap(df, "k").count() == 1000
    payload = review.review_payload(df.withColumn("s", F.lit("x")), "k", "k", ["s"]).collect()
    assert len(payload) == 5 and all(r["n_rows"] == 10 and r["payload"].count('"s":"x"') == 10 for r in payload)


# ---------------------------------------------------------------------- causal
def brute_matching(score, treated, y):
    total = 0.0
    for i in range(len(y)):
        other = np.flatnonzero(treated != treated[i])
        gaps = np.abs(score[other] - score[i])
        near = other[gaps == gaps.min()]
        low = near[score[near] == score[near].min()]  # a tie goes to the lower score
        match = y[low].mean()
        total += (y[i] - match) if treated[i] else (match - y[i])
    return total / len(y)


@pytest.mark.parametrize("levels", [400, 12, 2])
def test_matching_equals_brute_force(spark, levels):
    n = 500
    score = RNG.integers(0, levels, n) / 1024.0  # exact differences, many ties
    treated = RNG.random(n) < 0.3
    y = RNG.normal(size=n) + score
    rows = [(i, float(score[i]), int(treated[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, score double, t int, y double")
    row = causal.ate_matched(df, "t", "y", "k").first()
    assert math.isclose(row["ate"], brute_matching(score, treated, y), rel_tol=1e-9, abs_tol=1e-12)
    assert row["treated"] == treated.sum() and row["rows_used"] == n


def test_matching_first_and_one_arm(spark):
    rows = [(1, 0.5, 1, 10.0), (2, 0.5, 0, 4.0), (3, 0.5, 0, 8.0), (4, 0.75, 1, 1.0)]
    df = spark.createDataFrame(rows, "k bigint, score double, t int, y double")
    assert causal.ate_matched(df, "t", "y", "k", ties="first").first()["ate"] == ((10 - 4) + (10 - 4) + (10 - 8) + (1 - 4)) / 4
    assert causal.ate_matched(df.filter("t = 1"), "t", "y", "k").first()["ate"] is None
    with pytest.raises(ValueError):
        causal.ate_matched(df, "t", "y", "k", ties="any")


def test_effects_recover_the_truth(spark):
    n = 6000
    s = RNG.integers(0, 4, n)
    t = (RNG.random(n) < 0.2 + 0.15 * s).astype(int)
    y = 2.0 * t + 3.0 * s + RNG.normal(size=n)
    df = spark.createDataFrame([(i, int(t[i]), float(y[i]), int(s[i])) for i in range(n)], "k bigint, t int, y double, s int")
    strat = causal.ate_stratified(df, "t", "y", ["s"]).first()
    psm = causal.ate_psm(df, "t", "y", ["s"], "k").first()
    boot = causal.ate_interval(df, "k", "t", "y", ["s"]).first()
    assert abs(strat["ate"] - 2) < 0.15 and strat["ci_low"] < 2 < strat["ci_high"]
    assert math.isclose(psm["ate"], strat["ate"], rel_tol=1e-6)
    assert boot["ci_low"] < strat["ate"] < boot["ci_high"] and boot["replicates"] == 100
    with pytest.raises(ValueError):
        causal.ate_psm(df, "t", "y", [], "k")
    with pytest.raises(ValueError):
        causal.ate_psm(df, "t", "nope", ["s"], "k")


def test_prepare(spark):
    rows = [(1, 1, 2.0, "b", dt.datetime(2024, 1, 3, 1)), (2, 0, 3.0, "a", dt.datetime(2024, 1, 1, 12)), (3, 0, None, "c", dt.datetime(2024, 1, 1)), (4, 1, 1.0, None, None)]
    df = spark.createDataFrame(rows, "k bigint, t int, y double, g string, d timestamp_ntz")
    got = {r["k"]: (r["g"], r["d"]) for r in causal.causal_prepare(df, "t", "y", ["g", "d"], "k").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0)}


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_rows_of_a_frequent_text_are_not_one_task(spark, monkeypatch, sent):
    monkeypatch.setattr(causal, "BROADCAST_CODES", sent, raising=False)
    texts = {i: "hot" if i % 10 else f"v{i:04d}" for i in range(4000)}
    places = {v: float(i) for i, v in enumerate(sorted(set(texts.values())))}
    df = spark.createDataFrame([(i, i % 2, float(i), t, "ab"[i % 2]) for i, t in texts.items()], "k bigint, t int, y double, g string, h string").repartition(8)
    # joins as of tables that are too large to be sent, unless the code says so
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = causal.causal_prepare(df, "t", "y", ["g", "h"], "k").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["k"]: (r["g"], r["h"]) for r in got} == {i: (places[t], i % 2) for i, t in texts.items()} and len(got) == 4000
    held = np.bincount([r["task"] for r in got])
    assert held.max() < 1000


@pytest.mark.parametrize(
    ("orders", "total"),
    [
        ([80_000_000_000_000, 80_000_000_000_000, -80_000_000_000_000], 8_000_000_000_000_000_006),  # only on its way beyond a bigint
        ([80_000_000_000_000, 80_000_000_000_000, 1], None),  # no bigint holds it
        ([1, 2, 3], 600_006),
    ],
)
def test_keys_whose_sum_passes_a_bigint(spark, tmp_path, orders, total):
    rows = [(o, 2, 1, 1.0 + i, 10.0 * (i + 1), "R" if i else "N", "OF"[i % 2], dt.datetime(2024, 1, 1 + i)) for i, o in enumerate(orders)]
    schema = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = runner(QUERIES["causal_prepare"])(spark, str(tmp_path))
    assert dict(got.dtypes)["key_sum"] == "bigint"
    assert got.first().asDict() == {"key_sum": total, "n": 3, "treatment": 0.666667, "outcome": 20.0, "l_shipdate": 1.0, "l_linestatus": 0.666667, "top_code": 1.0}


# ------------------------------------------------------------------- chart data
def test_histogram_and_constant(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "x double, h string")
    bins = chartdata.chart_histogram(df, "x", bins=10).collect()
    assert sorted((r["bin"], r["n"]) for r in bins) == [(i, 10) for i in range(10)]
    assert chartdata.chart_histogram(df, "x", hue="h", bins=10).count() == 20
    flat = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [(r["bin"], r["n"]) for r in chartdata.chart_histogram(flat, "x").collect()] == [(0, 5)]


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in RNG.normal(size=2000)], "x double")
    curve = sorted((r["x"], r["density"]) for r in chartdata.chart_kde(df, "x").collect())
    assert 0.97 < np.trapezoid([d for _, d in curve], [x for x, _ in curve]) < 1.01


def test_kde_of_a_skewed_column(spark):
    """One far value: the mass at the low end must not vanish between the grid and the values."""
    df = spark.range(100_000).selectExpr("CASE WHEN id = 0 THEN 1e9 ELSE id % 101 END AS x")
    first = chartdata.chart_kde(df, "x").orderBy("i").first()
    h = df.selectExpr("stddev_samp(x) AS s").first()["s"] * 100_000**-0.2
    assert abs(first["density"] * h * (2 * 3.141592653589793) ** 0.5 - 0.99999) < 1e-4


def test_box_and_fit(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v, 2 * v + 1) for v in values], "g string, y double, z double")
    box = chartdata.chart_box(df, "g", "y").first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"], box["n_beyond"]) == (2, 3, 4, 1, 4, 1)
    fit = chartdata.chart_scatter_ols(df, "y", "z").first()
    assert math.isclose(fit["slope"], 2) and math.isclose(fit["intercept"], 1) and math.isclose(fit["r2"], 1)
    flat = chartdata.chart_scatter_ols(df.withColumn("one", F.lit(1.0)), "one", "z").first()
    assert flat["slope"] is None


def test_shares_and_overlay(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2] if i < 6 else None) for i in range(8)], "i bigint, c string")
    sided = split_by_filter(df, "i < 4")
    shares = {(r["value"], r["period"]): r["pct"] for r in chartdata.chart_drift_shares(sided, "c").collect()}
    assert shares == {("x", "baseline"): 0.5, ("y", "baseline"): 0.5, ("x", "target"): 0.25, ("y", "target"): 0.25, ("__NA__", "baseline"): 0.0, ("__NA__", "target"): 0.5}
    over = chartdata.chart_drift_overlay(sided, "i", bins=2).orderBy("bin").collect()
    assert [(r["baseline_n"], r["target_n"]) for r in over] == [(4, 0), (0, 4)]


# -------------------------------------------------------------- SQL, joins, sources
def test_sql_views(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert run_sql("```sql\nSELECT COUNT(*) AS n FROM df;\n```", df=df).first()["n"] == 10
    assert run_sql("WITH a AS (SELECT k FROM df) SELECT o.k FROM a JOIN other o ON a.k = o.k", df=df, other=df.limit(3)).count() == 3
    for bad in ("DROP TABLE df", "SELECT 1; SELECT 2", "INSERT INTO df VALUES (1)", ""):
        with pytest.raises(ValueError):
            run_sql(bad, df=df)
    with pytest.raises(Exception):
        run_sql("SELECT missing FROM df", df=df).collect()


def test_membership(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    ref = spark.createDataFrame([(1,), (1,), (None,)], "r bigint")
    row = reshape.membership_rate(df, "k", ref, "r").first()
    assert (row["n"], row["matched"]) == (3, 2) and math.isclose(row["rate"], 2 / 3)
    assert reshape.membership_rate(df, "k", ref.limit(0), "r").first()["rate"] is None
    assert reshape.dangling_rows(df, "k", ref, "r").count() == 1
    assert reshape.crosstab_wide(df.withColumn("b", F.lit("p")), "k", "b", ["p", "q"]).filter("q = 0").count() == 3


def test_sources_round_trip(spark):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "i int, s string, x double")
    path = scratch_path(spark, "t")
    sink_csv(df, path)
    assert sorted(tuple(r) for r in scan_csv(spark, path).collect()) == [(1, "a,b", 1.5), (2, None, None)]
    assert scan_csv(spark, path, "i bigint, s string, x double").schema["i"].dataType.typeName() == "long"
    other = scratch_path(spark, "p")
    sink_parquet(df, other, partition_by=["i"])
    assert scan_parquet(spark, other).count() == 2


# ------------------------------------------------------- intervals of the effects
def matched_by_loops(rows):
    """(ate, std_error) of nearest-neighbour matching with replacement; ties share, all by plain loops."""
    n, effects, share_of = len(rows), [], [0.0] * len(rows)
    serves = [[] for _ in rows]
    for s, t, y in rows:
        others = [(abs(s - o[0]), o[0]) for o in rows if o[1] != t]
        best = min(others)  # the nearest, then the lower score
        matches = [j for j, o in enumerate(rows) if o[1] != t and (abs(s - o[0]), o[0]) == best]
        mean = sum(rows[j][2] for j in matches) / len(matches)
        effects.append(y - mean if t else mean - y)
        for j in matches:
            serves[j].append(1 / len(matches))
    ate = sum(effects) / n
    total = sum((e - ate) ** 2 for e in effects)
    for i, (s, t, y) in enumerate(rows):
        same = [o[2] for o in rows if o[1] == t and o[0] == s]
        if len(same) > 1:
            variance = statistics.variance(same)
        else:
            best = min((abs(s - o[0]), o[0]) for o in rows if o[1] == t and o[0] != s)
            near = [o[2] for o in rows if o[1] == t and (abs(s - o[0]), o[0]) == best]
            variance = len(near) / (len(near) + 1) * (y - sum(near) / len(near)) ** 2
        k = sum(serves[i])
        total += variance * (k * k + 2 * k - sum(x * x for x in serves[i]))
    return ate, math.sqrt(total) / n


@pytest.mark.parametrize("levels", [3, 12, 1000])
def test_matching_error_equals_brute_force(spark, levels):
    rng = np.random.default_rng(levels)
    n = 160
    s = rng.integers(0, levels, n) / 64.0
    t = (rng.random(n) < 0.4).astype(int)
    y = 1.5 * t + np.sin(s) + rng.normal(size=n)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(s, t, y)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k bigint, score double, t int, y double").repartition(3)
    got = causal.ate_matched(df, "t", "y", "k").first()
    ate, error = matched_by_loops(rows)
    assert math.isclose(got["ate"], ate, rel_tol=1e-9) and math.isclose(got["std_error"], error, rel_tol=1e-9)


def test_matched_record(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.5), "xyz"[i % 3], dt.datetime(2024, 1, 1 + i % 20), [1.0], float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, t int, c string, d timestamp_ntz, a array<double>, y double")
    r = causal.ate_psm(df, "t", "y", ["c", "d", "a"], "k").first()
    assert (r["confounders"], r["converted_columns"], r["dropped_columns"]) == ("c, d, a", "d, c", "a")
    assert r["ci_low"] < r["ate"] < r["ci_high"] and r["rows_used"] == 300
    z = abs(r["ate"]) / ((r["ci_high"] - r["ci_low"]) / 2 / causal.NORMAL_95)
    assert math.isclose(r["p_value"], math.erfc(z / math.sqrt(2)), rel_tol=1e-9)
    with pytest.raises(ValueError):
        causal.ate_psm(df, "t", "a", ["c"], "k")


def simulated(seed, n=400):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 3, n)
    t = (rng.random(n) < 0.3 + 0.2 * s).astype(int)
    return s, t, 1.0 * t + 2.0 * s + rng.normal(size=n) * (1 + t)


def test_bootstrap_coverage():
    """The 95 % interval holds the true effect in about 95 of 100 simulated tables."""
    held, runs = 0, 300
    for seed in range(runs):
        s, t, y = simulated(seed)
        lots = np.random.default_rng(10_000 + seed).integers(0, 2**63, len(s), dtype=np.int64)
        batch = pa.record_batch({"stratum": pa.array([str(x) for x in s]), "treated": pa.array(t), "outcome": pa.array(y), "lot": pa.array(lots)})
        (low,), _, (high,), _ = [c.to_pylist() for c in next(replicates.interval(replicates.effects(replicates.fill([batch], 200), 200), 200)).columns]
        held += low <= 1.0 <= high
    assert 0.90 <= held / runs <= 0.985


def test_bootstrap_is_the_same_however_rows_are_dealt(spark):
    s, t, y = simulated(1, 3000)
    rows = [(i, int(t[i]) if i % 50 else None, float(y[i]), int(s[i]) if i % 7 else None, "p") for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, t int, y double, s int, `a b` string")
    runs = [causal.ate_interval(d, "k", "t", "y", ["s", "a b"]).first() for d in (df.repartition(1), df.repartition(7), df.repartition(3, "s"))]
    for other in runs[1:]:
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(runs[0], other))
    lots = np.array([r[0] for r in df.select(F.xxhash64("k", F.lit(7))).collect()])
    weights = replicates.poisson_weights(lots, 100)
    arm = np.array([-1 if r[1] is None else r[1] for r in rows])
    stratum = np.array([-1 if r[3] is None else r[3] for r in rows])
    gained = weight = 0.0
    for x in np.unique(stratum):
        one, none = (stratum == x) & (arm == 1), (stratum == x) & (arm == 0)
        n1, n0 = weights[one].sum(0), weights[none].sum(0)
        gained = gained + (n1 + n0) * ((weights[one] * y[one][:, None]).sum(0) / n1 - (weights[none] * y[none][:, None]).sum(0) / n0)
        weight = weight + n1 + n0
    want = np.percentile(gained / weight, [2.5, 50, 97.5])
    assert np.allclose([runs[0]["ci_low"], runs[0]["ate_median"], runs[0]["ci_high"]], want)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02


def test_bootstrap_without_an_arm(spark):
    df = spark.createDataFrame([(1, 1, 2.0, "s"), (2, 1, 3.0, None)], "k bigint, t int, y double, s string")
    assert tuple(causal.ate_interval(df, "k", "t", "y", ["s"]).first()) == (None, None, None, 0)
    assert tuple(causal.ate_interval(df.limit(0), "k", "t", "y", ["s"]).first()) == (None, None, None, 0)


def test_box_joins_counted_values_only(spark):
    rng = np.random.default_rng(6)
    values = {"hot": np.round(rng.normal(size=3000) * 10), "rare": rng.normal(size=40), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, y double")
    found = chartdata.chart_box(df, "g", "y")
    for r in found.collect():
        v = values[r["x"]]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        held = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [q1, q2, q3, held.min(), held.max()])
        assert (r["n"], r["n_beyond"]) == (len(v), len(v) - len(held))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "Join" in line)
    assert "Aggregate" in "".join(plan[first + 1 : first + 4])  # what is joined with the boxes has been counted


def test_column_lists_by_position(spark):
    cases = {
        "COLUMNS\n=\t[ a ,b ] and COLUMNS=[c]": ["a", "b"],
        "COLUMNS: none here, COLUMNS = x, then COLUMNS=[y]": ["y"],
        "columns=[a]": [],
        "the cOlUmNs :\n 'p', \"q\"\r\nrest": ["p", "q"],
        "COLUMNS=[] columns: z": ["z"],
        "COLUMNS=[a": [],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", replies.column_list(F.col("t")).alias("c")).collect()}
    assert got == cases
    assert spark.createDataFrame([(None,)], "t string").select(replies.column_list(F.col("t"))).first()[0] == []


def test_numeric_findings(spark):
    made = [("a", i, ["valid", "suspicious"][i % 2], f"r{i % 9}" if i % 2 else None, f"row {i}" if i % 2 else None, None if i < 3 else f"d{i}") for i in range(40)]
    df = spark.createDataFrame(made, "column_name string, reply_id int, verdict string, reason string, example string, description string")
    checked = spark.createDataFrame([("a", 77), ("b", 5)], "column_name string, n long")
    got = {r["column_name"]: r for r in review.numeric_verdict(df, checked).collect()}
    a, b = got["a"], got["b"]
    assert (a["type"], a["samples_checked"], a["verdict"], a["description"]) == ("numeric", 77, "suspicious", "d3")
    assert a["example_reasons"] == ["r1", "r3", "r5", "r7", "r0"] and a["example_rows"] == [f"row {i}" for i in (1, 3, 5, 7, 9)]
    assert (b["verdict"], b["example_reasons"], b["example_rows"], b["description"]) == ("valid", [], [], review.NOTHING_FOUND)
    bare = review.numeric_verdict(df.select("column_name", "verdict"), checked)
    assert {r["verdict"] for r in bare.collect()} == {"suspicious", "valid"}


def test_samples_checked(spark):
    df = spark.createDataFrame([("a", 0, "consistent", None, None, None, 10), ("a", 1, None, None, None, None, 7), ("b", 0, "inconsistent", "x", None, None, None)], REPLIES + ", n_rows int")
    got = {r["column_name"]: (r["type"], r["samples_checked"], r["n_replies"]) for r in review.findings(df).collect()}
    assert got == {"a": ("categorical", 17, 2), "b": ("categorical", 1, 1)}
