"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Equal vectors are one class, named by its smallest id. Every tree splits a sample of the classes at the median of their
projection on the line between two of them, down to ``leaf_rows`` rows a leaf; all classes are then dealt to one leaf of
every tree. A query has one queue for all trees, ordered by the squared distances to the planes that lie between the
query and a leaf; it takes leaves from the queue until they hold as many rows as ``target`` recall needs, and all rows
of these leaves are ranked by their exact inner product. The number of rows is measured: ``probes`` queries are compared
with an exact search over all rows. For vectors of unlike norms the trees see one more component, which brings all to
the longest norm, so that near in the tree means a large inner product.

What is bounded, and how: the sample for the planes (``sample_rows`` rows, at most ``sample_bytes``), hence the planes
that reach the tasks, and the ``probes`` queries. All rows are in every tree and all queries are answered. Leaves lie in shards
(subtrees of about ``shard_rows`` rows, larger ones sliced); a task holds one slice and streams the queries past it, and
returns what can still be among a query's best: twice the wanted rank among the sampled rows sets a floor.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without vec_id, take
no part; a vector meets those of its own length; rows with the query's vec_id are the query's own and never its
neighbours; repeated rows are candidates each and one query (of unlike vectors with one vec_id the least is the query);
ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored. Scores are sums in component
order in double precision and may overflow to infinity where components are beyond 1e150.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, shuffle_partitions

SPLIT_SAMPLE = 16  # sampled rows that a leaf must have for its parent to be split
MAX_LEAVES = 1024


@dataclass
class Forest:
    """The trees for vectors of one length. Node n of a tree has children 2n and 2n + 1; leaves are numbered from 0."""

    planes: np.ndarray  # trees x nodes x length, node 0 unused
    offsets: np.ndarray  # trees x nodes
    scale: float
    longest: float
    sample: np.ndarray  # the rows that the planes were found on
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0))  # trees x leaves
    shard_bits: int = 0
    budget: float = np.inf
    slices: dict[tuple[int, int], int] = field(default_factory=dict)

    @property
    def trees(self) -> int:
        return len(self.planes)

    @property
    def leaves(self) -> int:
        return self.planes.shape[1]

    @property
    def depth(self) -> int:
        return self.leaves.bit_length() - 1

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        lifted = lift(rows, self.scale, self.longest)
        out = np.empty((len(rows), self.trees), np.int32)
        for t in range(self.trees):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", lifted, self.planes[t][node]) >= self.offsets[t][node]
                node = 2 * node + side
            out[:, t] = node - self.leaves
        return out

    def queue(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the leaves of all trees, nearest first, as tree * leaves + leaf; and the rows met up to each."""
        asked = queries / self.scale
        asked = asked / np.sqrt((asked**2).sum(axis=1))[:, None] * self.longest
        asked = np.hstack([asked, np.zeros((len(asked), 1))])
        waits = []
        for t in range(self.trees):
            away = asked @ self.planes[t].T - self.offsets[t]
            wait = np.zeros((len(asked), 1))
            for level in range(self.depth):
                own = away[:, 1 << level : 2 << level]
                wait = np.stack([wait + np.maximum(own, 0) ** 2, wait + np.minimum(own, 0) ** 2], axis=2).reshape(len(asked), -1)
            waits.append(wait)
        order = np.argsort(np.hstack(waits), axis=1, kind="stable")
        return order, np.cumsum(self.sizes.reshape(-1)[order], axis=1)

    def floors(self, queries: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's kth best surely reaches: twice that rank among the sampled rows."""
        n = len(self.sample)
        if n < 2 * k:
            return np.full(len(queries), -np.inf)
        best = np.partition(queries @ self.sample.T, n - 2 * k, axis=1)[:, n - 2 * k]
        return best - 1e-9 * (1 + np.abs(best))

    def visits(self, queries: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(query, tree, shard, its leaves) until a query's leaves hold the budget."""
        order, met = self.queue(queries)
        per_query = (met < self.budget).sum(axis=1) + 1
        for q in range(len(queries)):
            taken = np.sort(order[q, : per_query[q]])
            shard = taken >> self.shard_bits
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            per_tree = self.leaves >> self.shard_bits
            for a, b in zip(first, np.r_[first[1:], len(taken)], strict=True):
                tree, part = divmod(int(shard[a]), per_tree)
                yield q, tree, part, taken[a:b] % self.leaves


def lift(rows: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """The rows, scaled, with a last component that brings all to the longest norm."""
    small = rows / scale
    rest = np.sqrt(np.maximum(longest**2 - (small**2).sum(axis=1), 0))
    return np.hstack([small, rest[:, None]])


def grow(rows: np.ndarray, leaves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes and offsets of one tree over lifted rows."""
    rng = np.random.default_rng(seed)
    planes, offsets = np.zeros((leaves, rows.shape[1]), np.float32), np.zeros(leaves)
    inside = {1: np.arange(len(rows))}
    for node in range(1, leaves):
        own = inside.pop(node)
        line = np.zeros(rows.shape[1])
        if len(own) > 1:
            one, other = rng.choice(own, 2, replace=False)
            line = rows[one] - rows[other]
        size = np.sqrt((line**2).sum())
        line = line / size if size > 0 else rng.standard_normal(len(line)) / np.sqrt(len(line))
        planes[node] = line
        along = rows[own] @ planes[node].astype(np.float64)
        offsets[node] = np.median(along) if len(own) else 0.0
        side = along >= offsets[node]
        inside[2 * node], inside[2 * node + 1] = own[~side], own[side]
    return planes, offsets


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part; the components keep their type if it is float."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = vectors["embedding"].cast("array<float>" if isinstance(kind, T.FloatType) else "array<double>")
    # The bound leaves out NaN and the infinities; a NULL makes the test NULL.
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= 1.7976931348623157e308, F.lit(False)))
    kept = vectors.filter(vectors["vec_id"].isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0))
    return kept.select(kept["vec_id"].cast("long").alias("vec_id"), v.alias("v"))


def _batches(rows: Iterator[pa.RecordBatch], at: int = 4096) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of one length."""
    for whole in rows:
        for start in range(0, whole.num_rows, at):
            batch = whole.slice(start, at)
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims):
                yield int(d), batch.filter(pa.array(dims == d))


def fit(classes: DataFrame, n: int, *, trees: int, leaf_rows: int, sample_rows: int, sample_bytes: int) -> dict[int, Forest]:
    """A forest for every length of which there are enough rows in a sample; planes are found by a task for each tree."""
    widest, most = classes.agg(F.max("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if widest is None:
        return {}
    wanted = min(sample_rows, max(1, sample_bytes // (8 * widest)))
    share = min(1.0, wanted / n)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / most) ** 2)
    longest = {r["dim"]: float(r["l"]) for r in classes.groupBy("dim").agg(F.sqrt(F.max(square)).alias("l"), F.count("*").alias("n")).filter(F.col("n") >= 2 * leaf_rows).collect()}
    drawn = classes.filter(F.pmod(F.xxhash64(F.lit(3), "class_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, tree = (k.as_py() for k in key)
        leaves = 1
        if dim in longest:
            while 2 * leaves <= min(MAX_LEAVES, table.num_rows / SPLIT_SAMPLE, table.num_rows / share / leaf_rows):
                leaves *= 2
        if leaves == 1:
            return pa.table({"dim": [], "tree": [], "node": [], "plane": [], "at": []}, schema=shape)
        order = np.argsort(table["class_id"].to_numpy())
        rows = lift(matrix(table["v"], table.num_rows)[order], most, longest[dim])
        planes, offsets = grow(rows, leaves, 7919 * tree + dim)
        return pa.table({"dim": [dim] * leaves, "tree": [tree] * leaves, "node": range(leaves), "plane": list(planes), "at": offsets}, schema=shape)

    shape = pa.schema({"dim": pa.int32(), "tree": pa.int32(), "node": pa.int32(), "plane": pa.list_(pa.float32()), "at": pa.float64()})
    dealt = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    # Every tree has one group of the sample's size, whatever the size of the table.
    found = dealt.groupBy("dim", "tree").applyInArrow(run, "dim int, tree int, node int, plane array<float>, at double").toArrow()
    if not found.num_rows:
        return {}
    rows = drawn.filter(F.col("dim").isin(sorted(set(found["dim"].to_pylist())))).select("dim", "v").toArrow()
    out = {}
    for d in sorted(set(found["dim"].to_pylist())):
        sample = rows.filter(pc.equal(rows["dim"], d))
        own = found.filter(pc.equal(found["dim"], d)).sort_by([("tree", "ascending"), ("node", "ascending")])
        planes = own["plane"].combine_chunks().flatten().to_numpy().reshape(trees, -1, d + 1)
        out[d] = Forest(planes, own["at"].to_numpy().reshape(trees, -1), most, longest[d], matrix(sample["v"], sample.num_rows))
    return out


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of each query's k best; ``scores`` holds -inf where a row is no candidate. The score
    returned is the sum in component order, whatever the order of the matrix product."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    place, at = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
    exact = np.cumsum(queries[place] * rows[at], axis=1)[:, -1] if len(place) else np.empty(0)
    order = np.lexsort((ids[at], -exact, place))
    place, found, exact = place[order], ids[at][order], exact[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    return place[rank < k], found[rank < k], exact[rank < k]


def exact_hits(classes: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The k best classes of a bounded set of queries by exact search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _batches(batches):
            if dim in asked:
                rows, (ids, queries) = matrix(batch["v"], batch.num_rows), asked[dim]
                place, found, score = best_of(queries, rows, batch["class_id"].to_numpy(), queries @ rows.T, k)
                yield pa.record_batch({"query_id": ids[place], "class_id": found, "score": score})

    hits = classes.select("dim", "class_id", "v").mapInArrow(run, "query_id long, class_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank")


def calibrate(classes: DataFrame, routed: DataFrame, queries: DataFrame, forests: dict[int, Forest], *, k: int, probes: int, target: float) -> None:
    """Set each forest's budget of rows to what ``target`` recall takes for a sample of the queries."""
    some = queries.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(probes).toArrow()
    asked = {}
    for d in forests:
        own = some.filter(pc.equal(pc.list_value_length(some["v"]), d))
        if own.num_rows:
            asked[d] = (own["vec_id"].to_numpy(), matrix(own["v"], own.num_rows))
    true = exact_hits(classes, asked, k + 1).join(routed.select("class_id", "dim", "leaves"), "class_id")
    rows = true.select("dim", "query_id", "class_id", "leaves").collect()  # at most probes * (k + 1)
    for d, (ids, asked_rows) in asked.items():
        forest = forests[d]
        order, met = forest.queue(asked_rows)
        where = np.empty_like(met)
        np.put_along_axis(where, order, met, axis=1)
        place = {int(q): i for i, q in enumerate(ids)}
        own = [r for r in rows if r["dim"] == d and r["class_id"] != r["query_id"]]
        if own:
            at = np.array([place[r["query_id"]] for r in own])
            cells = np.array([r["leaves"] for r in own]) + np.arange(forest.trees) * forest.leaves
            needed = float(np.quantile(where[at[:, None], cells].min(axis=1), target, method="higher"))
            forest.budget = max(needed, forest.trees * (k + 1))  # so many rows of all trees hold k + 1 different ones


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    trees: int = 8,
    leaf_rows: int = 64,
    shard_rows: int = 4096,
    sample_rows: int = 16384,
    sample_bytes: int = 64 << 20,
    probes: int = 256,
    target: float = 0.96,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every query.

    ``vectors`` and ``queries`` have vec_id and v, see ``usable``.
    """
    dim = F.size("v").alias("dim")
    same = Window.partitionBy("key", "v").orderBy("vec_id")
    copies = vectors.select("vec_id", "v", F.xxhash64("v").alias("key")).withColumn("n", F.row_number().over(same))
    # A result needs the k + 1 smallest ids of a class at most: all its members have the same score.
    named = copies.filter(F.col("n") <= k + 1).withColumn("class_id", F.first("vec_id").over(same))
    named = cut(named.select("vec_id", "class_id", F.when(F.col("n") == 1, F.col("v")).alias("v")), "forest-classes")
    members = named.select("class_id", F.col("vec_id"))
    classes = named.filter(F.col("v").isNotNull()).select(dim, "class_id", "v")
    one = Window.partitionBy("vec_id").orderBy("v")
    asked = queries.select("vec_id", "v").withColumn("n", F.row_number().over(one)).filter("n = 1").select(dim, "vec_id", "v")
    asked = cut(asked, "forest-queries")
    n = classes.count()
    spark = vectors.sparkSession
    forests = fit(classes, n, trees=trees, leaf_rows=leaf_rows, sample_rows=sample_rows, sample_bytes=sample_bytes) if n else {}
    shared = spark.sparkContext.broadcast(forests)
    component = classes.schema["v"].dataType.elementType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, batch in _batches(batches):
            forest = shared.value.get(d)
            leaves = forest.route(matrix(batch["v"], batch.num_rows)) if forest else np.zeros((batch.num_rows, 1), np.int32)
            offsets = pa.array(np.arange(0, leaves.size + 1, leaves.shape[1]), pa.int32())
            yield pa.record_batch({**{c: batch[c] for c in ("dim", "class_id", "v")}, "leaves": pa.ListArray.from_arrays(offsets, pa.array(leaves.reshape(-1)))})

    routed = cut(classes.mapInArrow(deal, f"dim int, class_id long, v array<{component}>, leaves array<int>"), "forest-leaves")
    in_leaves = routed.select("dim", F.posexplode("leaves").alias("tree", "leaf"))
    if forests:
        sizes = in_leaves.filter(F.col("dim").isin(list(forests))).groupBy("dim", "tree", "leaf").count().collect()
        for d, forest in forests.items():
            forest.sizes = np.zeros((forest.trees, forest.leaves), np.int64)
            for r in sizes:
                if r["dim"] == d:
                    forest.sizes[r["tree"], r["leaf"]] = r["count"]
            held = int(forest.sizes[0].sum())
            while forest.shard_bits < forest.depth and (held << forest.shard_bits + 1) // forest.leaves <= shard_rows:
                forest.shard_bits += 1
            rows = forest.sizes.reshape(forest.trees, -1, 1 << forest.shard_bits).sum(axis=2)
            forest.slices = {(int(t), int(s)): int(-(-rows[t, s] // (2 * shard_rows))) for t, s in np.argwhere(rows > 2 * shard_rows)}
        calibrate(classes, routed, asked, forests, k=k, probes=probes, target=target)
    shared = spark.sparkContext.broadcast(forests)
    KEY = ["dim", "tree", "shard", "slice"]

    def visit(batches: Iterator[pa.RecordBatch], floors: bool) -> Iterator[pa.RecordBatch]:
        for d, batch in _batches(batches, 256):
            forest, queries = shared.value.get(d), matrix(batch["v"], batch.num_rows)
            floor = forest.floors(queries, k + 1) if forest and floors else np.full(len(queries), -np.inf)
            found = list(forest.visits(queries)) if forest else [(q, 0, 0, np.zeros(1, np.int64)) for q in range(batch.num_rows)]
            rows = [(q, t, s, c, leaves) for q, t, s, leaves in found for c in range(forest.slices.get((t, s), 1) if forest else 1)]
            q = pa.array([r[0] for r in rows], pa.int64())
            columns = {"dim": pa.array([d] * len(rows), pa.int32())} | {c: pa.array([r[i] for r in rows], pa.int32()) for i, c in enumerate(KEY[1:], 1)}
            yield pa.record_batch(columns | {"id": batch["vec_id"].take(q), "leaves": pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32())), "v": batch["v"].take(q), "floor": pa.array(floor).take(q)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a slice come first, then the queries that visit it."""
        now, parts, held = None, [], None
        for whole in batches:
            keys = np.column_stack([whole[c].to_numpy() for c in (*KEY, "asks")])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if tuple(keys[a][:4]) != now:
                    now, parts, held = tuple(keys[a][:4]), [], None
                batch = whole.slice(a, b - a)
                if not keys[a][4]:
                    parts.append((batch["id"].to_numpy(), batch["leaves"].flatten().to_numpy(), matrix(batch["v"], batch.num_rows)))
                    continue
                if held is None:
                    held = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ()
                    order = np.argsort(held[1], kind="stable") if held else ()
                    held = tuple(x[order] for x in held)
                if held:
                    for at in range(0, batch.num_rows, 256):
                        yield from answer(batch.slice(at, 256), *held)

    def answer(batch: pa.RecordBatch, ids: np.ndarray, leaf: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        queries = matrix(batch["v"], batch.num_rows)
        wanted = batch["leaves"].flatten().to_numpy()
        by = np.repeat(np.arange(batch.num_rows), batch["leaves"].value_lengths().to_numpy())
        scores = np.full((batch.num_rows, len(ids)), -np.inf)
        for one in np.unique(wanted):
            a, b = np.searchsorted(leaf, [one, one + 1])
            if a < b:
                who = by[wanted == one]
                scores[who, a:b] = queries[who] @ rows[a:b].T
        scores[scores < batch["floor"].to_numpy()[:, None]] = -np.inf
        place, found, score = best_of(queries, rows, ids, scores, k + 1)
        yield pa.record_batch({"query_id": batch["id"].to_numpy()[place], "class_id": found, "score": score})

    sliced = [(d, t, s, c) for d, f in forests.items() for (t, s), c in f.slices.items()]
    bits = F.coalesce(*[F.when(F.col("dim") == d, F.lit(f.shard_bits)) for d, f in forests.items()], F.lit(0))
    placed = routed.select("dim", F.posexplode("leaves").alias("tree", "leaf"), "class_id", "v").withColumn("shard", F.call_function("shiftright", F.col("leaf"), bits))
    crowded = F.broadcast(spark.createDataFrame(sliced, "dim int, tree int, shard int, slices int"))  # at most trees * MAX_LEAVES a length
    placed = placed.join(crowded, ["dim", "tree", "shard"], "left").withColumn("slice", F.pmod(F.xxhash64("class_id"), F.coalesce("slices", F.lit(1))).cast("int"))
    stored = placed.select(*KEY, F.lit(0).alias("asks"), F.col("class_id").alias("id"), F.array("leaf").alias("leaves"), "v", F.lit(None).cast("double").alias("floor"))

    def ranked(*ties: str):
        return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)).cast("int")

    def top_of(some: DataFrame, floors: bool) -> DataFrame:
        """The best k + 1 classes found of some queries, written; with ``floors`` only what reaches a query's floor."""
        visits = some.mapInArrow(lambda batches: visit(batches, floors), f"dim int, tree int, shard int, slice int, id long, leaves array<int>, v array<{component}>, floor double")
        visits = visits.select(*KEY, F.lit(1).alias("asks"), "id", "leaves", "v", "floor")
        met = stored.unionByName(visits).repartition(4 * shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY, "asks")
        hits = met.mapInArrow(search, "query_id long, class_id long, score double").distinct()
        return cut(hits.withColumn("rank", ranked("class_id")).filter(F.col("rank") <= k + 1).drop("rank"), "forest-hits")

    top = top_of(asked, True)
    # A query may have missed so many sampled rows that too few reach its floor: it is asked again without one.
    full = top.groupBy("query_id").count().filter(F.col("count") > k)
    short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    if forests and not short.isEmpty():
        top = top.join(short, top["query_id"] == short["vec_id"], "left_anti").unionByName(top_of(short, False))
    near = top.join(members, "class_id").filter(F.col("vec_id") != F.col("query_id"))
    return near.withColumn("rank", ranked("vec_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
