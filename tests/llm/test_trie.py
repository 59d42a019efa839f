import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import trie
from plumbline.llm.common import WORD_RE

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int, words int"


def brute(rows):
    """The trie by Python dictionaries over whole sequences."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(r)] for c, r in own.items()}
    built = {}
    for c, r in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + r[h:]
    members = defaultdict(list)
    for c, r in built.items():
        for d in range(len(r) + 1):
            members[tuple(r[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        own_words = len(WORD_RE.findall(path[-1][1])) if path else 0
        saved[path] = sum(saved[x] for x in children[path]) + (len(members[path]) - 1) * own_words
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, rows_per_range=1_000_000, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.nodes(trie.prefixes(trie.rebuilt(trie.turns(df)), rows_per_range=rows_per_range), **options).select(*trie.NODE).collect()), key=str)


def some(seed, n):
    rng = random.Random(seed)
    texts = ["Hello there.", "a b c", "", None, "ein zwei\x0bdrei", " \n", "x" * 30_000, "word " * 20_000]
    roles = ["user", "assistant", None, "", "us"]
    rows = [(c, t, rng.choice(roles[:2]), rng.choice(texts[:3]) if rng.random() < 0.8 else f"own {c} {t}") for c in range(n) for t in range(rng.randint(1, 6))]
    rows += [(c, None, rng.choice(roles), rng.choice(texts)) for c in range(0, n, 7)]  # turns without number
    rows += [(c, 2, "user", "Same turn.") for c in range(0, n, 9)] + rows[:6]  # ties and repeated rows
    rows += [(None, 0, "user", "No id."), (-25, 0, "user", "Below zero."), (-20, 0, "user", "Base below zero.")]
    return rows


def test_equals_brute_force(spark):
    rows = some(1, 70)
    assert run(spark, rows) == brute(rows)


def test_full_and_narrow_sketches_agree(spark):
    rows = some(2, 40)
    assert run(spark, rows, max_width=16) == brute(rows)  # nearly all counters are full, little is proven
    assert run(spark, rows, max_width=64) == brute(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(9000) for t in range(2)]
    assert run(spark, rows) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(5, t, "user", "again and again") for t in range(5000)] + [(0, 0, "user", "again and again"), (40, 0, "user", "other")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows_per_range", [2, 7, 300])
def test_large_conversations_are_summed_in_ranges(spark, rows_per_range):
    rows = some(5, 25) + [(c, t, "user", f"long {t % 50}") for c in (41, 40, 60, 7) for t in range(900)] + [(47, None, "user", "no number")] * 30
    assert run(spark, rows, rows_per_range) == brute(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    own = trie.rebuilt(trie.turns(df))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.count("given").alias("given_n"))
    ranged, _ = trie._ranges(own, sizes, rows_per_range)
    largest = ranged.filter("conv_id = 41").groupBy("range").count().agg(F.max("count")).first()[0]
    assert largest <= max(6, 3 * rows_per_range)  # of 900 rows


def test_turnless_conversations(spark):
    short = [c for c in range(100, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(c, 0, "user", "one") for c in short[:4]]  # no base, and fewer turns than they give up
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 4


def test_empty(spark):
    assert run(spark, []) == []


def test_estimate_one_is_a_proof():
    rng = np.random.default_rng(1)
    digests = [rng.bytes(16) for _ in range(300)]
    many = pa.array(digests + digests[:50], pa.binary())
    for width in (16, 256, 4096):
        counts = np.zeros((trie.DEPTH, width), int)
        for at in trie.places(many, width):
            counts[np.arange(trie.DEPTH), at] += 1
        at = trie.places(pa.array(digests, pa.binary()), width)
        least = np.min([counts[i, at[:, i]] for i in range(trie.DEPTH)], axis=0)
        assert (least[:50] >= 2).all()
        if width == 4096:
            assert (least[50:] == 1).mean() > 0.95
