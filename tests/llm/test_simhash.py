from itertools import combinations

import numpy as np
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import components
from tests.llm.cases import frame, rows


def plain(text):
    """The contract's fingerprint, shingle by shingle."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, most=2):
    """Components by trying every pair."""
    label = list(range(len(prints)))
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    return label


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        one = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + int(rng.integers(0, 2))
        for n in (1, 2):
            two = one
            for bit in rng.choice(64, n, replace=False).tolist():
                two ^= 1 << bit
            place, key = simhash.golay_keys(np.array([one, two], dtype=np.uint64))
            assert set(key[place == 0].tolist()) & set(key[place == 1].tolist())
            assert len(key) <= 36


def test_fingerprints(spark):
    made = rows(2, 30)
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(frame(spark, made)).collect()}
    assert got == {(m[0], f"{plain(m[1]):016x}") for m in made}


def test_components_equal_brute_force(spark):
    made = rows(7, 60)
    prints = [plain(m[1]) for m in made]
    label = groups(prints)
    least = {x: min((m[0] for m, y in zip(made, label, strict=True) if x == y and m[0] is not None), default=None) for x in label}
    want = sorted(((m[0], f"{p:016x}", least[x]) for m, p, x in zip(made, prints, label, strict=True)), key=str)
    for bucket in (128, 1):  # joined keys, and stars for every key
        got = sorted(map(tuple, simhash.near_duplicates(frame(spark, made), bucket=bucket).collect()), key=str)
        assert got == want


def test_links_join_chains_and_crowds(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 60, 5), 2)}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 40)}
    chain = int(rng.integers(0, 1 << 62))
    for bit in range(0, 40, 2):
        chain ^= (1 << bit) | (1 << (bit + 1))
        prints.add(chain)
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (1000, 4):
        edges = simhash.links(table, bucket)
        assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in edges.collect())
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        assert same([root.get(p, p) for p in prints], groups(prints))


def test_one_of_each_group_stays(spark):
    docs = frame(spark, rows(7, 60))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    label = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in found}
    got = [label[r["doc_id"], f"{plain(r['text']):016x}"] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, set(label.values())))
    assert all(r["doc_id"] == g for r, g in zip(kept.collect(), got, strict=True))


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.drop_near_duplicates(frame(spark, [])).collect() == []
    got = simhash.near_duplicates(frame(spark, [(5, None) + (None,) * 9, (3, " ") + (None,) * 9])).collect()
    assert {tuple(r) for r in got} == {(5, "0" * 16, 3), (3, "0" * 16, 3)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (2, 1), (100, 3)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (100, 1), (8, 8), (9, 8)}
