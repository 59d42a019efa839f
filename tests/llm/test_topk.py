import math
import random

from plumbline.llm import topk


def brute(rows, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, a in {i: v for i, v in ok if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    unit = lambda d: [rng.gauss(0, 0.2) for _ in range(d)]
    hot = unit(6)
    rows = [(i, unit(6)) for i in range(0, 900, 3)] + [(i, hot) for i in range(1, 400, 3)] + [(1000, hot), (1100, [0.0] * 6)]
    rows += [(2000, unit(3)), (2001, unit(3)), (2100, []), (2101, [])]
    rows += [(None, hot), (1200, None), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, [math.nan] * 6), (1500, [math.inf] + [0.0] * 5), (1600, [1e6] * 6)]
    rows += [(3001, hot), (3001, hot)]  # a repeated row
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score int, v double")
    v = topk.quantized(df)
    for options in ({}, {"shard_rows": 60, "block_rows": 2, "leaf": 8}):
        got = topk.top_k(v, v.filter("vec_id % 100 = 0"), k=7, **options)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 7)


def test_whole_numbers_beyond_doubles(spark):
    rows = [(0, [1e6, 1e6]), (1, [3e6, 1.0]), (2, [3e6, 1.0009765625]), (3, [-1e6, 0.0])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id = 0"), k=2).collect()) == brute(rows, 2)


def test_empty(spark):
    v = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).collect() == []
