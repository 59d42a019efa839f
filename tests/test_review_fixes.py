"""Cases of the last review: each failed on the code before it."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import causal, chartdata, drift, isolation, ordering, relations, replies, score, sqlview

SCHEMA = "verdict string, reason string"


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    j = replies.parse_json(F.col("reply"), SCHEMA)
    return [r["v"] for r in df.select("i", j["verdict"].alias("v")).orderBy("i").collect()]


def test_long_and_nested_replies(spark):
    body = '{"verdict": "bad", "reason": "' + "x" * 1_000_000 + '"}'
    deep = '{"verdict": "deep", "a": {"b": {"c": {"d": {"e": 1}}}}}'
    texts = [f"So I think {body} is right", f"```json\n{body}\n```", body, f"prose {deep} prose", "no braces", "} backwards {", "{", None]
    assert verdicts(spark, texts) == ["bad", "bad", "bad", "deep", None, None, None, None]


def test_writes_are_refused(spark):
    df = spark.range(3).toDF("k")
    for text in ("WITH a AS (SELECT 1 AS k) INSERT INTO t SELECT * FROM a", "DROP TABLE t", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2", "SET a=b", "not sql"):
        with pytest.raises(ValueError):
            sqlview.run_sql(text, t=df)
    spark.range(7).toDF("k").createOrReplaceTempView("t")
    assert sqlview.run_sql("```sql\nWITH a AS (SELECT k FROM t WHERE k IN (SELECT max(k) FROM t)) SELECT ';' AS s, k FROM a;\n```", t=df).collect()[0]["k"] == 2
    assert spark.table("t").count() == 7
    spark.catalog.dropTempView("t")


def test_keys_beyond_doubles(spark):
    rows = [(2**60 + i, "2024-01-01 00:00:00") for i in range(100)]
    df = spark.createDataFrame(rows, "k long, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert drift.split_by_time(df, "ts", "k").filter("in_base").agg(F.max("k")).first()[0] == 2**60 + 69
    moved = df.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, CASE WHEN k % 2 = 0 THEN 1 ELSE 5 END)"))
    for name in ("ts", "value", "range_id", "column_name"):
        got = score.monotone_order(df.withColumnRenamed("ts", name), [name], "k").collect()
        assert [(r["column_name"], r["ordered"]) for r in got] == [(name, True)]
    assert not score.monotone_order(moved, ["ts"], "k").first()["ordered"]


def test_split_by_time_is_a_plain_filter(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, id)").alias("ts"))
    split = drift.split_by_time(df, "ts", "k")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ubquery" not in plan
    assert split.filter("in_base").count() == 700
    assert drift.split_by_time(df.limit(0), "ts", "k").count() == 0


def test_data_columns_called_like_helpers(spark):
    rows = [(f"s{i % 300}", i % 7, float(i), "2024-0%d-01 00:00:00" % (1 + i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "segment string, g int, period double, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = drift.drift_segment(df, "g", ["segment"]).collect()
    assert len(got) == 7 and {r["dof"] for r in got} == {299}
    assert all(r["psi"] is not None for r in drift.psi_series(df, "ts", ["period"]).collect())
    with pytest.raises(ValueError):
        drift.split_by_filter(df.withColumn("in_base", F.lit(1)), "g = 1")


def test_all_segments_without_multiplication(spark):
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), (F.sin("id") * 100).alias("v"), F.when(F.col("id") % 40 == 3, F.lit(5.0)).otherwise(F.col("id") % 11).alias("w"))
    found = drift.drift_segment(df, "g", ["v", "w"])
    got = {(r["column_name"], r["segment"]): r for r in found.collect()}
    assert len(got) == 80 and len(drift.drift_segment(df, "g", ["v"], k=12).collect()) == 12
    for name, g in (("v", 0), ("v", 17), ("w", 3), ("w", 8)):
        sided = drift.split_by_filter(df, f"g = {g}")
        want = drift.drift_population(sided, [name]).first()
        for key in ("ks_stat", "psi"):
            assert got[name, str(g)][key] == pytest.approx(want[key], abs=1e-9), (name, g, key)


def test_share_histogram_of_many_equal_shares(spark):
    ids = spark.range(400_000).select(F.col("id").cast("string").alias("v"))
    sided = drift.unite(ids, ids, ["v"])
    assert drift.psi_share_hist(sided, ["v"]).first()["psi_share_hist"] == pytest.approx(0.0)


def test_correlation_reads_once(spark):
    names = [f"x{i}" for i in range(40)]
    df = spark.range(3000).select(*[F.when(F.rand(i) < 0.8, F.rand(100 + i) + (F.col("id") / 3000)).alias(n) for i, n in enumerate(names)])
    found = relations.corr_matrix(df, names)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 * 39 // 2


@pytest.mark.parametrize("key", ["k", "k % 3", "1"])
def test_forest_needs_no_key(spark, key):
    rows = spark.range(30_000).select(F.lit("x").alias("column_name"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 977) / 100.0).alias("value"), F.expr(key.replace("k", "id")).alias("k"))
    planted = [("x", 1e6 + 1e4 * i, 1) for i in range(60)]
    rows = rows.unionByName(spark.createDataFrame(planted, "column_name string, value double, k long"))
    steps = isolation.forest_steps(rows.select("column_name", "value"))
    scored = isolation.with_score(rows.select("column_name", "value"), steps)
    assert scored.filter("value >= 1e6").agg(F.min("score")).first()[0] > scored.filter("value < 1e6").agg(F.max("score")).first()[0]


def test_quantile_plans_grow_with_the_probabilities(spark):
    long = spark.range(1000).select(F.lit("x").alias("column_name"), F.rand(1).alias("value"))

    def size(n):
        plan = ordering.exact_quantiles(long, ["column_name"], [i / n for i in range(n + 1)])
        return len(plan._jdf.queryExecution().optimizedPlan().toString())

    assert size(20) < 3 * size(5) + 20_000


def test_scores_are_matched_as_they_are(spark):
    rows = [(i, float(i % 50) + i * 1e-7, i % 2, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, t int, y double")
    scored = causal.propensity_scores(df, "t", ["x"])
    assert scored.select("score").distinct().count() > 150


def test_auto_columns_leave_out_free_text(spark):
    df = spark.range(500).select(F.concat(F.lit("long text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("a"), F.concat(F.lit("k"), (F.col("id") % 51).cast("string")).alias("b"), F.lit("x").alias("c"))
    assert drift.auto_columns(df) == ["a", "c"]


def test_no_ranking_no_charts(spark):
    df = spark.range(3).toDF("k")
    assert chartdata.chart_worst_columns(df, spark.createDataFrame([], "place int, column_name string")).collect() == []
