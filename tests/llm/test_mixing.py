from collections import Counter

import numpy as np
import pytest

from plumbline.llm import mixing
from plumbline.llm.common import WORD_RE
from tests.llm.cases import frame, rows


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 5).tolist() != mixing.permute(np.arange(1000), 1000, 6).tolist()


def test_targets_share_the_excess():
    got = mixing.targets([100, 1000, 1000, 0], [10, 1, 2, 3])
    assert got[0] == 300 and got[3] == 0
    assert got[1] == pytest.approx(600) and got[2] == pytest.approx(1200)
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0.0]


def test_shards_meet_the_quotas():
    counts = mixing.shard_counts([50, 0, 7, 1000], 100, 3)
    assert counts.sum(axis=0).tolist() == [50, 0, 7, 1000] and (counts.sum(axis=1)[:-1] == 100).all()


def test_taken_words(spark):
    made = rows(3, 150)
    mixed = mixing.mix(frame(spark, made), block_words=8, stream_docs=20, shard_slots=64)
    got = mixing.taken(mixed).collect()
    size = lambda t: len(WORD_RE.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((m[0], size(m[1])) for m in made)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        by[r["source"]][2] += r["taken"]
        by[r["source"]][3] += r["size"]
    assert set(by) == {"a", "b", "c", None}
    aims = mixing.targets([by[s][3] for s in ("a", "b", "c", None)], [1, 2, 3, 1])
    for s, aim in zip(("a", "b", "c", None), aims, strict=True):
        assert by[s][0] == pytest.approx(aim) and by[s][1] == by[s][3] and abs(by[s][2] - aim) <= 0.05 * aim + 16
    again = mixing.taken(mixing.mix(frame(spark, made[::-1]), block_words=8, stream_docs=20, shard_slots=64)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pieces_are_whole_and_in_order(spark):
    mixed = mixing.mix(frame(spark, rows(4, 60)), block_words=8, stream_docs=20, shard_slots=64)
    pieces = mixed.pieces.collect()
    slots = {}
    for p in pieces:
        slots.setdefault((p["shard"], p["position"]), []).append(p)
    for held in slots.values():  # a block's pieces fill it from its start without a gap
        held.sort(key=lambda p: p["place"])
        assert held[0]["place"] == 0 and all(a["place"] + a["words"] == b["place"] for a, b in zip(held, held[1:]))
        assert len({(p["source_no"], p["block"], p["copy"]) for p in held}) == 1
    assert len({(s[0]["source_no"], s[0]["copy"], s[0]["block"]) for s in slots.values()}) == len(slots)  # once in a pass


def test_documents_of_the_mix(spark):
    docs = frame(spark, rows(5, 60))
    options = {"block_words": 8, "stream_docs": 20, "shard_slots": 64}
    out = mixing.documents(docs, **options)
    assert out.columns == docs.columns
    words = sum(len(WORD_RE.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.taken(mixing.mix(docs, **options)).collect())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert mixing.cut_text("a  b\nc d", [0, 1, 3], [1, 1, 1]) == "a  b\nd"


def test_empty(spark):
    assert mixing.taken(mixing.mix(frame(spark, []))).collect() == []
    got = mixing.taken(mixing.mix(frame(spark, [(1, None) + (None,) * 9]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows(1, 10)), max_sources=1)


def test_shards_are_drawn_alike_by_every_task(monkeypatch):
    rng = np.random.default_rng(1)
    quotas = rng.integers(0, 5000, 40)
    quotas[3] = 40_000  # a hot source
    for exact in (10**9, 1000):  # all draws exact, or those of large parts by the normal distribution
        monkeypatch.setattr(mixing, "EXACT", exact)
        counts = mixing.shard_counts(quotas.tolist(), 512, 9)
        assert (counts.sum(axis=0) == quotas).all() and (counts >= 0).all()
        assert (counts.sum(axis=1)[:-1] == 512).all() and 0 < counts[-1].sum() <= 512
        before = np.cumsum(counts, axis=0) - counts
        for shard in (0, 7, len(counts) - 1):
            own, first = mixing.draw(quotas, 512, shard, 9)
            assert (own == counts[shard]).all() and (first == before[shard]).all()
        share = counts[:-1, 3] / 512  # the hot source's share of a shard strays as in a random draw
        expected = quotas[3] / quotas.sum()
        assert abs(share.mean() - expected) < 0.01 and 0.5 < share.std() / np.sqrt(expected * (1 - expected) / 512) < 1.5
