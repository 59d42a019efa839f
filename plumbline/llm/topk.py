"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt to shards by hash, queries to blocks; a task holds one shard's ball tree and one block of queries.
For a query the nodes are opened in order of their inner-product upper bound (q.centre + |q| * radius) until no bound
reaches the kth score. The kth score is shared: a block's home shard is searched first, and its kth scores start the
search of every other shard, which returns only what can still be among the best.

Scores are exact: whole numbers whose products stay below 2^53 are multiplied as doubles, others as 64-bit integers.

Defined cases: vectors that are NULL or hold NULL or non-finite components, and rows without vec_id, take no part; a
vector meets those of its own length (no components: score 0); rows with the query's vec_id are the query's own;
repeated rows are candidates each, and one query; ties go to the smaller vec_id; an empty table gives no rows; other
columns are ignored. Components beyond 2^31 in size may overflow the 64-bit score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows that take no part are left out."""
    v = vectors["embedding"].cast("array<double>")
    # The bound leaves out NaN and the infinities; a NULL makes the test NULL.
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x) <= 1.7976931348623157e308, F.lit(False)))
    kept = vectors.filter(vectors["vec_id"].isNotNull() & v.isNotNull() & whole)
    return kept.select(kept["vec_id"].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


class BallTree:
    """Balls over the rows of a matrix: centres, radii, and rows (leaves) or children (inner nodes)."""

    def __init__(self, rows: np.ndarray, leaf: int):
        centres, radii, self.inside = [], [], []
        stack = [(np.arange(len(rows)), -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            points = rows[own]
            centre = points.mean(axis=0)
            away = np.sqrt(((points - centre) ** 2).sum(axis=1))
            at = len(centres)
            centres.append(centre)
            radii.append(away.max())
            self.inside.append(own)
            if parent >= 0:
                self.inside[parent][side] = at
            if len(own) > leaf and radii[-1] > 0:
                # Split across the line from the farthest point to the one farthest from it.
                one = points[away.argmax()]
                other = points[((points - one) ** 2).sum(axis=1).argmax()]
                order = np.argsort(points @ (other - one), kind="stable")
                self.inside[at] = [0, 0]
                stack += [(own[order[: len(own) // 2]], at, 0), (own[order[len(own) // 2 :]], at, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner product in each ball, with room for rounding."""
        norms = np.sqrt((queries**2).sum(axis=1))
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return queries @ self.centres.T + np.outer(norms, self.radii) + 1e-9 * np.outer(norms, reach) + 1e-6


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, leaf: int):
    """For each query its best k rows that reach the floor: (query places, ids, scores)."""
    tree = BallTree(rows.astype(np.float64), leaf)
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if most < 2**52 else np.int64
    rows, asked = rows.astype(kind), queries.astype(kind)
    bounds = tree.bounds(queries.astype(np.float64))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(len(queries)):
        own, kth = bounds[q].tolist(), float(floors[q])
        best_score, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-own[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            inside = tree.inside[node]
            if isinstance(inside, list):
                for child in inside:
                    if own[child] >= kth:
                        heapq.heappush(heap, (-own[child], child))
                continue
            score = (rows[inside] @ asked[q]).astype(np.int64)
            good = (score >= kth) & (ids[inside] != query_ids[q])
            if good.any():
                best_score, best_id = np.concatenate([best_score, score[good]]), np.concatenate([best_id, ids[inside][good]])
                order = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[order], best_id[order]
                if len(best_score) == k:
                    kth = max(kth, float(best_score[-1]))
        out.append((np.full(len(best_id), q), best_id, best_score))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, shard_rows: int = 8192, block_rows: int = 2048, leaf: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of every query.

    ``vectors`` and ``queries`` have vec_id and v (array of longs), see ``quantized``.
    """
    vectors, queries = cut(vectors.select("vec_id", "v"), "topk-vectors"), queries.select("vec_id", "v").dropDuplicates(["vec_id"])
    shards = max(1, -(-vectors.count() // shard_rows))
    queries = cut(queries, "topk-queries")
    blocks = max(1, -(-queries.count() // block_rows))
    dim = F.size("v").alias("dim")
    held = vectors.select(dim, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), "vec_id", "v")
    asked = queries.select(dim, F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).alias("block"), "vec_id", "v")
    home = F.pmod("block", F.lit(shards))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        query_ids = right["vec_id"].to_numpy()
        place, ids, scores = search(
            left["vec_id"].to_numpy(), _matrix(left["v"], left.num_rows), query_ids, _matrix(right["v"], right.num_rows), right["floor"].to_numpy(), k, leaf
        )
        return pa.table({"query_id": query_ids[place.astype(np.int64)], "vec_id": ids, "score": scores})

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """Each block of queries in each shard that its rows name."""
        wanted = right.select(*(F.col(c).alias(c) for c in ("dim", "shard", "block"))).distinct()
        dealt = held.join(F.broadcast(wanted) if blocks * shards <= 10_000 else wanted, ["dim", "shard"])
        return dealt.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(run, HITS)

    lowest = -(1 << 63)
    first = cut(meet(held, asked.withColumn("shard", home).withColumn("floor", F.lit(lowest).cast("double"))), "topk-home")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    floors = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").withColumn("floor", F.coalesce(F.col("least"), F.lit(lowest)).cast("double"))
    others = floors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).filter(F.col("shard") != home)
    rest = meet(held, others.select("dim", "shard", "block", "vec_id", "v", "floor"))
    best = first.union(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
