import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing
from tests.llm.cases import frame, rows


def ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return struct.pack(f"<{len(found)}I", *found)


def check(made, pieces, window):
    """Every id in exactly one piece; sequences gapless, full or of power-of-two length."""
    parts = defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) // 4 > 0
        parts[p["sequence_id"]].append(p)
    for own in parts.values():
        own.sort(key=lambda p: p["offset"])
        assert own[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:]))
        total = sum(p["length"] for p in own)
        assert total == window or total < window and total & (total - 1) == 0
    want = Counter()
    for m in made:
        own = ids(m[1])
        want.update((m[0], i, own[4 * i : 4 * i + 4], len(own) // 4) for i in range(len(own) // 4))
    got = Counter((p["doc_id"], p["start"] + i, p["ids"][4 * i : 4 * i + 4], p["doc_tokens"]) for p in pieces for i in range(p["length"]))
    assert got == want


def test_every_id_is_packed_once(spark):
    made = rows(1, 60)
    for options in ({}, {"window": 64, "shard_docs": 7, "cached": 50, "terms": 3}):
        pieces = [r.asDict() for r in packing.pack(frame(spark, made), **options).collect()]
        check(made, pieces, options.get("window", 2048))


def test_digest(spark):
    made = rows(2, 10, odd=False)
    whole = {(r["doc_id"], r["start"]): r for r in packing.pack(frame(spark, made)).collect()}
    for r in packing.digest(packing.pack(frame(spark, made))).collect():
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"], r["start"]]["ids"])


def test_neighbours_are_alike(spark):
    """Half of the documents are about one thing: a window holds its seed's kind first."""
    made = [(i, (" ".join(["ocean tide harbour"] * 3) if i % 2 else " ".join(["garden seed shovel"] * 3)) + f" number{i}", "en", "a", 1, 1, "r", 1, 2, 0.5, "k") for i in range(40)]
    pieces = packing.pack(frame(spark, made).coalesce(1), window=64).collect()
    kinds = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        kinds[p["sequence_id"]].append(p["doc_id"] % 2)
    full = [k for k in kinds.values() if len(k) > 2]
    assert sum(len(set(k)) == 1 for k in full) >= len(full) - 2


def test_empty(spark):
    assert packing.pack(frame(spark, [])).collect() == []
    got = packing.pack(frame(spark, [(1, None) + (None,) * 9])).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"], bytes(r["ids"])) for r in got] == [(1, 0, 1, 1, 0, b"\1\0\0\0")]
