import math
import random

import numpy as np

from plumbline.llm import forest
from plumbline.llm.queries import op11_projection_forest


def exact(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        asked = min(v for i, v in ok if i == q)
        scored = [(-sum_in_order(asked, v), i) for i, v in ok if i != q and len(v) == len(asked)]
        out[q] = [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def search(spark, rows, k, **options):
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v double, class_id string")
    v = forest.usable(df)
    got = {}
    for r in forest.neighbours(v, v.filter("vec_id % 20 = 0"), k=k, **options).collect():
        got.setdefault(r["query_id"], []).append(tuple(r))
    return {q: sorted(x, key=lambda r: r[1]) for q, x in got.items()}


def recall(got, true):
    found = sum(len({r[2] for r in got.get(q, [])} & {r[2] for r in rows}) for q, rows in true.items())
    return found / sum(map(len, true.values()))


def test_recall_scores_and_ranks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(16)]) for i in range(3000)]
    true = exact(rows, 10)
    got = search(spark, rows, 10, trees=6, leaf_rows=32, shard_rows=256, probes=60)
    assert recall(got, true) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        assert [r[1] for r in found] == list(range(1, 11))
        assert all(r[3] == sum_in_order(vectors[q], vectors[r[2]]) and r[2] != q for r in found)
        assert found == sorted(found, key=lambda r: (-r[3], r[2]))


def test_small_and_odd_tables_are_exact(spark):
    rng = random.Random(5)
    unit = lambda d: [rng.gauss(0, 0.2) for _ in range(d)]
    hot = unit(6)
    rows = [(i, unit(6)) for i in range(0, 60, 3)] + [(i, hot) for i in range(1, 100, 3)] + [(1000, hot), (1020, [0.0] * 6)]
    rows += [(2000, unit(3)), (2001, unit(3)), (2100, []), (2101, [])]  # lengths of their own, and none
    rows += [(None, hot), (1200, None), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, [math.nan] * 6), (1500, [math.inf] + [0.0] * 5), (1600, [1e6] * 6)]
    rows += [(3001, hot), (3001, hot), (3020, hot), (3020, unit(6)), (4000, [5.0])]  # repeated ids, a query without candidates
    true = {q: r for q, r in exact(rows, 7).items() if r}
    assert search(spark, rows, 7) == true


def test_copies_in_a_forest(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1200)]
    rows += [(i, rows[20][1]) for i in range(1200, 1800)]  # a third are copies of one vector
    got = search(spark, rows, 5, trees=6, leaf_rows=16, shard_rows=64, probes=60)
    true = exact(rows, 5)
    assert recall(got, true) >= 0.9
    assert got[20] == true[20] and [r[2] for r in got[20]] == [1200, 1201, 1202, 1203, 1204]


def test_slices_of_crowded_shards(spark):
    rng = random.Random(7)
    rows = [(i, [1 + rng.gauss(0, 1e-3) for _ in range(4)]) for i in range(900)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(900, 1100)]
    got = search(spark, rows, 5, trees=4, leaf_rows=200, shard_rows=32, probes=50)
    assert recall(got, exact(rows, 5)) >= 0.9


def test_empty(spark):
    v = forest.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert forest.neighbours(v, v).collect() == []


def test_registered_query_reaches_its_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in op11_projection_forest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(tuple(r))
    true = exact(rows, 20)
    assert set(got) == set(true) and all(len(x) == 20 for x in got.values()) and recall(got, true) >= 0.9


def test_lifted_rows_have_one_norm():
    rows = np.array([[3.0, 4.0], [0.0, 1.0]])
    assert np.allclose((forest.lift(rows, 1.0, 5.0) ** 2).sum(axis=1), 25)
