"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``.

A row may be kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3); a user or assistant without text may
be inserted anywhere (I, 2). Blank rows and duplicates must go; a truncated row that stays adds 1. Among the cheapest
edits those whose initials are least in ASCII order are taken.

``audits`` reads the roles and faults of a conversation in order (no texts) and keeps, for each of the four states of
the pattern, the cost and the edits that lead there. Edits are linked nodes that share their beginnings (``Prefixes``):
a node knows its parent, the hash of all edits up to it, and ancestors at distances that are powers of two. Equal costs
are decided by a search for the longest common prefix over these ancestors; equal hashes are verified node by node where
they are not one node. What all states share is written off as bytes, so that the nodes cover only what is open: memory
grows by one byte a row, which is the audit itself. ``repaired`` streams the texts past the audits; a conversation's
texts are never held together.

A duplicate is found by grouping (conversation, role, digest of the text), not by remembering a conversation's rows.

Defined cases: a NULL role or text reads as one space; rows without conv_id are one conversation; NULL turns come first;
rows of one turn are taken by role, then by the SHA-256 of their text; repeated rows are rows of their own, hence
duplicates; a row whose role is empty adds nothing to the roles and may be kept anywhere; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shuffle_partitions

KEEP, RENAME, DELETE, INSERT = b"KRDI"
COST = {RENAME: 2, DELETE: 3, INSERT: 2}
# States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The user or assistant that a state asks for, and the state after it.
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)
NEVER = float("inf")
SHAPE = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Prefixes:
    """Strings of edits as a tree of linked nodes; node 0 is the empty string."""

    MOD, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687

    def __init__(self) -> None:
        self.parent, self.edit, self.depth, self.hash = [0], [0], [0], [0]
        self.ups: list[tuple[int, ...]] = [()]

    def add(self, parent: int, edit: int) -> int:
        """The node for ``parent`` and one more edit. Its ancestors at distance 1, 2, 4, ... are kept as far as these
        distances divide its depth: two links a node on average, and any ancestor is a few links away."""
        depth = self.depth[parent] + 1
        ups, j, at = [parent], 1, parent
        while depth & ((1 << j) - 1) == 0:
            at = self.ups[at][j - 1]
            ups.append(at)
            j += 1
        self.parent.append(parent)
        self.edit.append(edit)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * self.BASE + edit) % self.MOD)
        self.ups.append(tuple(ups))
        return len(self.parent) - 1

    def drop_last(self) -> None:
        for column in (self.parent, self.edit, self.depth, self.hash, self.ups):
            column.pop()

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            room = self.depth[node] - depth
            ups = self.ups[node]
            node = ups[min(len(ups), room.bit_length()) - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same edits, link by link until the nodes meet."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def text(self, node: int, above: int = 0) -> bytes:
        """The edits below the node ``above``."""
        out = bytearray()
        while node != above:
            out.append(self.edit[node])
            node = self.parent[node]
        return bytes(reversed(out))

    def least(self, x: int, y: int) -> int:
        """The node whose string is the lesser one."""
        if x == y:
            return x
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b] and self.same(a, b):
            return x if self.depth[x] <= self.depth[y] else y
        if self.hash[a] != self.hash[b]:
            # Climb while the strings differ; where all links lead to equal ones, the last edits differ.
            climbing = True
            while climbing:
                for p, q in zip(reversed(self.ups[a]), reversed(self.ups[b]), strict=True):
                    if self.hash[p] != self.hash[q]:
                        a, b = p, q
                        break
                else:
                    climbing = False
            if self.same(self.parent[a], self.parent[b]):
                return x if self.edit[a] < self.edit[b] else y
        # Two strings share a hash: compare them whole.
        return x if self.text(x) <= self.text(y) else y

    def settle(self, live: list[int]) -> tuple[bytes, list[int]]:
        """Give up what all ``live`` nodes share: the shared edits, and the nodes' new numbers."""
        shared = live[0]
        for node in live[1:]:
            depth = min(self.depth[shared], self.depth[node])
            shared, node = self.ancestor(shared, depth), self.ancestor(node, depth)
            while shared != node:
                shared, node = self.parent[shared], self.parent[node]
        kept: set[int] = set()
        for node in live:
            while node != shared and node not in kept:
                kept.add(node)
                node = self.parent[node]
        said, old = self.text(shared), self.__dict__.copy()
        self.__init__()
        number = {shared: 0}
        for node in sorted(kept):  # a parent's number is the smaller one
            number[node] = self.add(number[old["parent"][node]], old["edit"][node])
        return said, [number[node] for node in live]


class Repair:
    """The cheapest edits of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.nodes = Prefixes()
        self.settled = bytearray()
        self.room = 4096
        self.best = [(0, 0), (NEVER, 0), (NEVER, 0), (NEVER, 0)]
        self._insert(self.best)

    def _offer(self, best: list[tuple[float, int]], state: int, cost: float, parent: int, edit: int) -> None:
        had, node = best[state]
        if cost > had or cost == NEVER:
            return
        new = self.nodes.add(parent, edit)
        if cost == had and self.nodes.least(node, new) == node:
            self.nodes.drop_last()
        else:
            best[state] = (cost, new)

    def _insert(self, best: list[tuple[float, int]]) -> None:
        # No cheapest edits have more than two inserts in a row; 2 is left for 3 after all ways into it.
        for state in (0, 1, 3, 2):
            cost, node = best[state]
            self._offer(best, WANTED[state][1], cost + COST[INSERT], node, INSERT)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        now: list[tuple[float, int]] = [(NEVER, 0)] * 4
        for state, (cost, node) in enumerate(self.best):
            if cost == NEVER:
                continue
            if not must_go:
                after = STEPS.get((state, initial)) if initial else state
                if after is not None:
                    self._offer(now, after, cost + truncated, node, KEEP)
                self._offer(now, WANTED[state][1], cost + truncated + COST[RENAME], node, RENAME)
            self._offer(now, state, cost + COST[DELETE], node, DELETE)
        self._insert(now)
        # From state 3 all goes on as from 0 or 1, but that a system row is deleted instead of kept: dearer states end here.
        done = now[3][0]
        if done + COST[DELETE] < now[0][0]:
            now[0] = (NEVER, 0)
        if done < now[1][0]:
            now[1] = (NEVER, 0)
        self.best = now
        if len(self.nodes.parent) > self.room:
            said, live = self.nodes.settle([n for c, n in now if c < NEVER])
            self.settled += said
            places = iter(live)
            self.best = [(c, next(places)) if c < NEVER else (c, 0) for c, _ in now]
            self.room = 4096 + 4 * len(self.nodes.parent)

    def end(self) -> tuple[int, str]:
        """Cost and edits."""
        (cost, node), (other, rival) = (self.best[s] for s in ENDS)
        if other < cost or other == cost and self.nodes.least(node, rival) == rival:
            cost, node = other, rival
        return int(cost), (self.settled + self.nodes.text(node)).decode("ascii")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, has_turn, turn, role, digest, text: what the order and the faults of rows depend on."""
    c = conversations
    role, text = (F.coalesce(c[name].cast("string"), F.lit(" ")).alias(name) for name in ("role", "text"))
    rows = c.select(c["conv_id"], c["turn"].isNotNull().alias("has_turn"), c["turn"], role, text)
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


ORDER = ["conv_id", "has_turn", "turn", "role", "digest"]


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(4 * shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the faults of its rows (each row's first one), the cost and the initials of its edits."""
    rows = ordered(conversations)
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    flagged = rows.select(*ORDER, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    again = F.struct("has_turn", "turn")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(again).alias("first"), F.max(again).alias("last"))
    firsts = firsts.filter("first < last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = flagged.join(firsts, same, "left").withColumn("seen", F.coalesce(again > F.col("first"), F.lit(False)))
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[dict] = []

        def close() -> None:
            gaps = now["most"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
            cost, audit = now["repair"].end()
            done.append({c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in (*ORDER, "blank", "truncated", "seen")), strict=True):
                conv, has, turn, role, digest, blank, truncated, seen = row
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        close()
                    now = {"conv_id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "least": 0, "most": 0, "row": None, "repair": Repair()}
                if has:
                    now["least"] = turn if not now["turns"] else now["least"]
                    now["turns"] += not now["turns"] or turn != now["most"]
                    now["most"] = turn
                before = now["row"]
                now["illegal"] += before is not None and before[2][:1] + role[:1] not in ("su", "ua", "au")
                seen = not blank and (seen or before == (has, turn, role, digest))
                truncated = truncated and not blank and not seen
                now["row"] = (has, turn, role, digest)
                for name, is_so in (("blank", blank), ("duplicate", seen), ("truncated", truncated)):
                    now[name] += is_so
                now["repair"].row(role[:1], blank or seen, truncated)
                if len(done) >= 1024:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done.clear()
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    shape = SHAPE.format(id=kind)
    schema = pa.schema([("conv_id", to_arrow_type(conversations.schema["conv_id"].dataType)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    return _by_conversation(seen.select(*ORDER, "blank", "truncated", "seen"), *ORDER).mapInArrow(run, shape)


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the rows after the edits of ``found`` (see ``audits``). A conversation's rows
    are consecutive and in order within a partition."""
    texts = ordered(conversations).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv_id", "audit")
    for column in texts.schema:
        if column.name not in heads.columns:
            heads = heads.withColumn(column.name, F.lit(None).cast(column.dataType))
    both = texts.unionByName(heads)
    stream = _by_conversation(both, "conv_id", F.col("audit").isNull(), *ORDER[1:])
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "place", "edit", "role", "text")
        out: list[tuple] = []
        conv, audit, at, state, place = None, "", 0, 0, 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal state, place
            out.append((conv, place, edit, role, text))
            if edit != "K":
                state = WANTED[state][1]
            elif role:
                state = STEPS[state, role[:1]]
            place += 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", WANTED[state][0], "")
                at += 1

        for batch in batches:
            for of, said, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if said is not None:
                    inserts()
                    conv, audit, at, state, place = of, said, 0, 0, 0
                    continue
                inserts()
                if audit[at] != "D":
                    put(audit[at], role if audit[at] == "K" else WANTED[state][0], text)
                at += 1
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.record_batch([pa.array(list(x), batch["conv_id"].type if c == "conv_id" else pa.int64() if c == "place" else pa.string()) for c, x in zip(names, columns, strict=True)], names)
            kept, out = batch["conv_id"].type, []
        inserts()
        if out:
            yield pa.record_batch([pa.array(list(x), kept if c == "conv_id" else pa.int64() if c == "place" else pa.string()) for c, x in zip(names, zip(*out, strict=True), strict=True)], names)

    return stream.select("conv_id", "audit", "role", "text").mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def fingerprints(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` of its rows, joined by newlines; rows as ``repaired`` gives them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kept = None, None, None
        for batch in batches:
            ids, shas = [], []
            for of, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if state is not None:
                        ids.append(conv)
                        shas.append(state.hexdigest())
                    conv, state = of, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            kept = batch["conv_id"].type
            yield pa.record_batch([pa.array(ids, kept), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([conv], kept), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    ``[.!?]`` from it, 3 repeats it, 4 makes its role user. NULLs read as one space."""
    c = conversations
    conv, turn, role, text = (F.coalesce(c[name].cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text"))
    how = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = c.select(
        c["conv_id"],
        c["turn"],
        F.when(how == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
        how.alias("how"),
    ).filter("how <> 0")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("conv_id", "turn", "role", "text")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table: the faults planted by ``damage``, the audit, and a fingerprint of what the repair gives."""
    rows = damage(conversations)
    found = cut(audits(rows), "repair-audits")
    shas = fingerprints(repaired(rows, found))
    every = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = every.join(found.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    both = both.join(shas.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
