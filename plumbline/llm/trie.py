"""A trie of conversations: which openings are shared, by how many, and what sharing them saves.

A node is a distinct sequence of the first d turns (role and text). ``prefixes`` numbers each conversation's turns and adds
up their hashes to a 128-bit digest per prefix; only digests and word counts are shuffled, never texts.

A count-min sketch of all prefix digests is filled by the tasks and merged block by block. An estimate of one proves
that a prefix belongs to one conversation, and so do all that continue it: such tails are written as nodes where they
are read, without a shuffle; only the first node of a tail asks for its parent. What remains, prefixes that may be
shared and whose parent may be shared, is grouped exactly by digest. Leaves and savings of a subtree are sums over the members of its
top: a conversation counts as a leaf where it is the smallest one that ends in a childless node, and saves a turn where
it is not the smallest member, so a suffix sum along each conversation replaces a walk over the tree.

The sketch has four rows of at least twice as many counters as there are prefixes, at most ``max_width``; beyond it fewer
singletons are proven and more prefixes are grouped, with the same result.

Defined cases: rows without conv_id take no part; a NULL role or text reads as empty; NULL turns come first; rows of one
turn are taken by the SHA-256 of role and text; repeated rows are turns of their own; a conversation without turns is a
member of the root, which exists if any conversation does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, n_words, shuffle_partitions

DEPTH = 4  # rows of the sketch
BLOCK = 1 << 16
IDS = 4096  # conversation ids whose endings are gathered together
EMPTY = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------------ rebuilt
def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, has_turn, turn, digest, words: a turn is its digest from here on."""
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")) for n in ("role", "text"))
    # The role's length keeps role and text apart.
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].isNotNull().alias("has_turn"), c["turn"], F.unhex(key).alias("digest"), n_words(text).alias("words"))
    return rows.filter("conv_id IS NOT NULL")


def rebuilt(own: DataFrame, *, group: int = 20, heads: int = 4) -> DataFrame:
    """Turns with ``skip`` (own turns to leave out at the beginning) and ``given`` (turns of the group's first
    conversation that stand in for them, in order): crc32 of the decimal id modulo ``heads`` gives their number."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    plain = own.withColumn("skip", F.when(F.col("conv_id") == base, 0).otherwise(taken)).withColumn("given", F.lit(None).cast("int"))
    first = Window.partitionBy("conv_id").orderBy("has_turn", "turn", "digest")
    opening = own.filter(F.col("conv_id") % group == 0).withColumn("given", F.row_number().over(first)).filter(F.col("given") < heads)
    opening = opening.withColumnRenamed("conv_id", "base")
    ids = own.select("conv_id").distinct().withColumn("skip", taken).withColumn("base", base).filter("conv_id <> base AND skip > 0")
    # A base has fewer than ``group`` others and at most ``heads`` - 1 turns to lend.
    lent = ids.join(opening, "base").filter("given <= skip")
    return plain.unionByName(lent.select(*plain.columns))


def _ranges(rows: DataFrame, sizes: DataFrame, rows_per_range: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``range``, and for the conversations of more than ``rows_per_range`` rows, which alone have several,
    (conv_id, range, before, given_n, n): the rows of the ranges before and the sizes of the whole."""
    large = sizes.filter(F.col("n") > rows_per_range)  # there are at most rows / rows_per_range of them
    if large.isEmpty():
        return rows.withColumn("range", F.lit(0)), None
    grid = [i / 1024 for i in range(1, 1024)]
    step = F.greatest(F.lit(1), F.floor(F.lit(1024 * rows_per_range) / F.col("n")))
    points = rows.join(F.broadcast(large.select("conv_id", "n")), "conv_id").groupBy("conv_id", "n").agg(F.percentile_approx("turn", grid).alias("p"))
    cuts = cut(points.select("conv_id", F.array_distinct(F.filter("p", lambda x, i: i % step == step - 1)).alias("cuts")), "trie-cuts")
    inside = F.when(F.col("given").isNull() & F.col("turn").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("turn"))))
    ranged = rows.join(F.broadcast(cuts), "conv_id", "left").withColumn("range", F.when(F.col("cuts").isNotNull(), F.coalesce(inside, F.lit(0))).otherwise(0)).drop("cuts")
    counted = ranged.join(F.broadcast(large), "conv_id").groupBy("conv_id", "range", "given_n", "n").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, cut(counted.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m"), "trie-ranges")


def prefixes(rows: DataFrame, *, rows_per_range: int = 1_000_000) -> DataFrame:
    """conv_id, depth, digest, parent, words, last: one row per prefix of at least one turn, and one of depth 0 for a
    conversation without turns.

    A prefix's digest is the sum of 128-bit hashes of (depth, turn) over its turns, so it is a running total, and a
    conversation can be summed in ranges of its turns: one that holds a third of all rows is many tasks' work. The
    digest of no turns is all zeros.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count("given").alias("given_n"), F.max("skip").alias("skip"))
    sizes = cut(sizes, "trie-sizes")
    ranged, before = _ranges(rows, sizes.drop("skip"), rows_per_range)
    one = Window.partitionBy("conv_id", "range")
    order = one.orderBy(F.col("given").isNull(), "given", "has_turn", "turn", "digest")
    if before is not None:
        ranged = ranged.join(F.broadcast(before), ["conv_id", "range"], "left")  # at most one row for rows_per_range rows
    else:
        ranged = ranged.withColumns({c: F.lit(None).cast("long") for c in ("before", "given_n", "n")})
    placed = ranged.withColumn("place", F.row_number().over(order) + F.coalesce("before", F.lit(0)))
    placed = placed.withColumns({"given_n": F.coalesce("given_n", F.count("given").over(one)), "n": F.coalesce("n", F.count("*").over(one))})
    own = F.col("given").isNull()
    kept = placed.filter(~own | (F.col("place") - F.col("given_n") > F.col("skip")))
    depth = (F.col("place") - F.when(own, F.col("skip")).otherwise(0)).cast("long")
    total = F.col("n") - F.least(F.col("skip"), F.col("n") - F.col("given_n"))
    kept = kept.select("conv_id", "range", depth.alias("depth"), "digest", "words", (depth == total).alias("last"))
    # Four sums of 32 bits, so that none overflows.
    halves = [f(x) for x in (F.xxhash64("depth", "digest"), F.xxhash64(F.lit(1), "depth", "digest")) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(0xFFFFFFFF))]
    hashed = kept.select("conv_id", "range", "depth", "words", "last", *(h.alias(f"h{i}") for i, h in enumerate(halves)))
    so_far = one.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut(hashed.select("*", *(F.sum(f"h{i}").over(so_far).alias(f"s{i}") for i in range(4))), "trie-sums")
    carried = [F.lit(0)] * 4
    if before is not None:
        ends = summed.join(F.broadcast(before.select("conv_id").distinct()), "conv_id", "left_semi").groupBy("conv_id", "range").agg(*(F.sum(f"h{i}").alias(f"e{i}") for i in range(4)))
        earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select("conv_id", "range", *(F.sum(f"e{i}").over(earlier).alias(f"c{i}") for i in range(4)))
        summed = summed.join(F.broadcast(carry), ["conv_id", "range"], "left")
        carried = [F.coalesce(f"c{i}", F.lit(0)) for i in range(4)]

    def packed(sums) -> Column:
        return F.unhex(F.concat(*(F.lpad(F.hex(x % (1 << 32)), 8, "0") for x in sums)))

    digest = packed(F.col(f"s{i}") + carried[i] for i in range(4))
    parent = packed(F.col(f"s{i}") - F.col(f"h{i}") + carried[i] for i in range(4))
    found = summed.select("conv_id", "depth", digest.alias("digest"), parent.alias("parent"), "words", "last")
    bare = sizes.filter((F.col("given_n") == 0) & (F.col("n") <= F.col("skip")))
    none = [F.lit(0).cast("long"), F.lit(bytes(16)), F.lit(None).cast("binary"), F.lit(0).cast("long"), F.lit(True)]
    return found.unionAll(bare.select("conv_id", *none))


# ---------------------------------------------------------------- count-min sketch
def places(digests: pa.Array, width: int) -> np.ndarray:
    """The counters of each digest, one in each row of the sketch: two halves of the digest, combined."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return np.stack([(halves[:, 0] + np.uint64(i) * (halves[:, 1] | np.uint64(1))) >> np.uint64(64 - width.bit_length() + 1) for i in range(DEPTH)], axis=1).astype(np.int64)


def sketch(found: DataFrame, width: int) -> np.ndarray:
    """Counters (0, 1, or 2 for more) of all prefix digests: filled by tasks, merged by block."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            if batch.num_rows:
                at = places(batch["digest"], width)
                for i in range(DEPTH):
                    one, many = np.unique(at[:, i], return_counts=True)
                    counts[i, one] = np.minimum(counts[i, one] + np.minimum(many, 2), 2)
        blocks = counts.reshape(-1, min(BLOCK, width))
        used = np.flatnonzero(blocks.any(axis=1))
        for k in used:
            yield pa.record_batch({"block": pa.array([int(k)]), "counts": pa.array([zlib.compress(blocks[k].tobytes(), 1)])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows follow each other; one block is open at a time."""
        block, counts = None, None
        for batch in batches:
            for k, packed in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield pa.record_batch({"block": pa.array([block]), "counts": pa.array([zlib.compress(counts.tobytes(), 1)])})
                    block, counts = k, np.zeros(min(BLOCK, width), np.uint8)
                counts = np.minimum(counts + np.frombuffer(zlib.decompress(packed), np.uint8), 2)
        if block is not None:
            yield pa.record_batch({"block": pa.array([block]), "counts": pa.array([zlib.compress(counts.tobytes(), 1)])})

    shape = "block long, counts binary"
    filled = found.filter("depth > 0").select("digest").mapInArrow(fill, shape)
    merged = filled.repartition(shuffle_partitions(found.sparkSession), "block").sortWithinPartitions("block").mapInArrow(merge, shape)
    out = np.zeros((DEPTH * width // min(BLOCK, width), min(BLOCK, width)), np.uint8)
    for row in merged.toLocalIterator():  # DEPTH * width bytes at most
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.reshape(DEPTH, width)


def screened(found: DataFrame, max_width: int) -> DataFrame:
    """``found`` with ``shared`` and ``parent_shared``: whether the sketch leaves open that others share the prefix."""
    n = found.filter("depth > 0").count()
    width = min(max_width, 1 << max(4, (2 * n).bit_length()))
    counts = found.sparkSession.sparkContext.broadcast(sketch(found, width))

    def estimate(digests: pa.Array) -> np.ndarray:
        out = np.full(len(digests), 2, np.uint8)
        known = np.flatnonzero(digests.is_valid().to_numpy(zero_copy_only=False))
        if len(known):
            at = places(digests.take(pa.array(known)), width)
            out[known] = np.min([counts.value[i, at[:, i]] for i in range(DEPTH)], axis=0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch["depth"].to_numpy() <= 1  # the root is every conversation's
            shared, above = estimate(batch["digest"]) > 1, (estimate(batch["parent"]) > 1) | root
            yield pa.record_batch({**{c: batch[c] for c in batch.schema.names}, "shared": shared, "parent_shared": above})

    shape = "conv_id long, depth long, digest binary, parent binary, words long, last boolean, shared boolean, parent_shared boolean"
    return found.mapInArrow(run, shape)


# ------------------------------------------------------------------------- nodes
def endings(ended: DataFrame) -> DataFrame:
    """(digest, conv_id) rows to the SHA-256 of each digest's ids in order, joined by commas: a hot node's ids are
    gathered in ranges of ids and hashed as a stream."""
    ranges = ended.groupBy("digest", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    stream = ranges.repartition(shuffle_partitions(ended.sparkSession), "digest").sortWithinPartitions("digest", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch["digest"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if digest != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids)).encode())
            yield pa.record_batch({"digest": pa.array([d for d, _ in done], pa.binary()), "ends_sha256": pa.array([s for _, s in done], pa.string())})
        if state is not None:
            yield pa.record_batch({"digest": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    return stream.select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(found: DataFrame, *, max_width: int = 1 << 24) -> DataFrame:
    """All nodes of the trie over ``prefixes``."""
    found = cut(found, "trie-prefixes")
    seen = cut(screened(found, max_width), "trie-screened")
    open_, tails = F.col("shared") & F.col("parent_shared"), ~(F.col("shared") & F.col("parent_shared"))
    some = seen.filter(F.col("depth") > 0)
    own = some.filter(open_).select("conv_id", "depth", "digest", "parent", "words", "last")
    first = some.filter(tails & F.col("parent_shared"))  # the first node of a tail
    # Exact grouping of what may be shared.
    grouped = cut(own.groupBy("digest").agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth")), "trie-grouped")
    children = grouped.filter("depth > 1").select("parent").unionByName(first.filter("depth > 1").select("parent"))
    children = children.groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    shaped = grouped.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # Along each conversation: what it saves from a depth on, and whether it stands for the leaf it ends in.
    placed = own.join(shaped.select("digest", "least", "n_children"), "digest")
    along = Window.partitionBy("conv_id")
    deeper = along.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    leaf = F.max(F.when(F.col("last"), (F.col("n_children") == 0) & (F.col("conv_id") == F.col("least")))).over(along)
    summed = placed.select(
        "digest",
        F.sum(F.when(F.col("conv_id") > F.col("least"), F.col("words")).otherwise(0)).over(deeper).alias("saved"),
        F.coalesce(leaf, F.lit(True)).cast("long").alias("leaf"),  # one that ends in a tail has a leaf of its own
    )
    sums = summed.groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ended = endings(own.filter("last").select("digest", "conv_id"))
    above = grouped.select(F.col("digest").alias("parent"), F.col("least").alias("parent_conv_id"))
    whole = cut(shaped.join(sums, "digest").join(ended, "digest", "left"), "trie-whole")
    # No grouped parent: the parent is a proven singleton, so this conversation's own node. Nodes of depth 1 need no
    # join: all have one parent, the root, which would be one hot key.
    unknown = F.lit(None).cast("long").alias("parent_conv_id")
    whole = whole.filter("depth > 1").join(above, "parent", "left").unionByName(whole.filter("depth = 1").select("*", unknown))
    open_nodes = whole.select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

    def tail(rows: DataFrame, parent) -> DataFrame:
        ends = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"),
        )

    heads = tail(first.filter("depth > 1").join(above, "parent", "left"), F.coalesce("parent_conv_id", "conv_id"))
    below = tail(some.filter(tails & (~F.col("parent_shared") | (F.col("depth") == 1))), F.col("conv_id"))
    inner = cut(open_nodes.unionByName(heads), "trie-inner").unionByName(below)
    # The root: its children's sums, and the conversations without turns.
    turnless = seen.filter("depth = 0").select(F.lit(bytes(16)).alias("digest"), "conv_id")
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = inner.filter("depth = 1").select("conv_id", "n_convs", one.alias("n_children"), "n_leaves", "saved_tokens", F.lit(EMPTY).alias("e"), no.alias("ended"))
    parts = parts.unionAll(turnless.select("conv_id", one, no, no, no, F.lit(EMPTY), no))
    parts = parts.unionAll(endings(turnless).select(F.lit(None).cast("long"), no, no, no, no, "ends_sha256", one))
    root = parts.agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), unknown, F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), one).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max_by("e", "ended").alias("ends_sha256"),
    )
    root = cut(root.filter("conv_id IS NOT NULL"), "trie-root")
    least = root.first()
    parent = F.when(F.col("depth") == 1, F.lit(least["conv_id"] if least else None)).otherwise(F.col("parent_conv_id")).cast("long")
    return inner.withColumn("parent_conv_id", parent).select(*NODE).unionByName(root.select(*NODE))
