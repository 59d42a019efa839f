import hashlib
import re

from plumbline.llm import substring
from tests.llm.cases import frame, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(made, window=13):
    words = [(m[0], WORDS.findall(m[1] or "")) for m in made]
    place = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, float("inf")), place(i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < place(i):
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    made = rows(11, 120)
    for options in ({}, {"part_words": 300, "chunks_each": 3}):
        got = substring.remove_repeats(frame(spark, made).repartition(3), **options).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(made)


def test_other_widths_and_texts(spark):
    made = rows(12, 60, odd=False)
    got = substring.remove_repeats(frame(spark, made), window=6, part_words=200).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(made, 6)
    kept = substring.remove_repeats(frame(spark, made), texts=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in kept) == sorted(brute(made))


def test_no_shuffle_of_texts(spark):
    plan = substring.remove_repeats(frame(spark, rows(13, 20)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning.*\n.*text#", plan) and "Bucketed: true" in plan


def test_empty(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []
    got = substring.remove_repeats(frame(spark, [(1, None) + (None,) * 9])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
