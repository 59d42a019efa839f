import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import quality
from tests.llm.cases import frame, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_model(texts):
    """Interpolated modified Kneser-Ney over code points, straight from the definition."""
    counts = {4: Counter()}
    for text in texts:
        x = [quality.START] * 3 + [ord(c) for c in " ".join(WORDS.findall(text))]
        counts[4].update(tuple(x[i : i + 4]) for i in range(len(x) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off = {}
    for n, c in counts.items():
        t = [sum(1 for v in c.values() if v == i) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        off[n] = [0] + [max(0.0, min(i, i - (i + 1) * y * t[i + 1] / t[i])) if t[1] and t[i] else 0.5 for i in (1, 2, 3)]
    total, spare = defaultdict(int), defaultdict(float)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            spare[n, g[:-1]] += off[n][min(v, 3)]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        if not total[n, g[:-1]]:
            return p(g[1:])
        v = counts[n][g]
        return (v - off[n][min(v, 3)] * (v > 0) + spare[n, g[:-1]] * p(g[1:])) / total[n, g[:-1]]

    return p


def brute_measures(text):
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_measures():
    for text in [m[1] or "" for m in rows(1)] + ["a b c d e f a b c d e\na b c d e\n\n \n \nx # x\na b c d e", "to be " * 9, "é\x85ü #&|"]:
        assert quality.measure(text) == brute_measures(text)


@pytest.mark.parametrize("model_bytes", [1 << 28, 3000, 0])
def test_scores_equal_brute_force(spark, model_bytes):
    """All languages in one broadcast, some alone, and none (scored by a join)."""
    made = rows(2, 30)
    got = quality.rate(frame(spark, made), model_bytes=model_bytes).collect()
    models = {lang: brute_model([m[1] or "" for m in made if m[2] == lang]) for lang in {m[2] for m in made}}
    want = []
    for m in made:
        x = [quality.START] * 3 + [ord(c) for c in " ".join(WORDS.findall(m[1] or ""))]
        total = -sum(math.log(models[m[2]](tuple(x[i : i + 4]))) for i in range(len(x) - 3))
        n = len(WORDS.findall(m[1] or ""))
        want.append((str(m[0]), n, round(total / n, 3) if n else None))
    assert Counter((str(r["doc_id"]), r["n_words"], None if r["log_perplexity"] is None else round(r["log_perplexity"], 3)) for r in got) == Counter(want)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["low"] <= r["deviation"] <= r["high"])


def test_unseen_text_backs_off():
    """Probabilities of all symbols after any context add up to one less the unseen symbol's share."""
    p = brute_model(["abracadabra abba", "cab"])
    symbols = [ord(c) for c in "abrcd "]
    for context in ("abr", "zzz", "cab"):
        got = sum(p((*map(ord, context), s)) for s in symbols)
        assert 0.9 < got < 1


def test_keep_returns_the_documents(spark):
    docs = frame(spark, rows(3, 40))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    wanted = Counter(r["doc_id"] for r in quality.rate(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == wanted
    by = {m[0]: m for m in rows(3, 40) if m[0] is not None}
    assert all(tuple(r) == by[r["doc_id"]] for r in kept.collect() if r["doc_id"] is not None)


def test_junk_is_outside_the_band(spark):
    made = [(*m[:2], "en", *m[3:]) for m in rows(4, 120, odd=False)]
    junk = [(10_000 + i, " ".join(w + "&%$#"[i % 4 :] * 3 for w in (m[1] or "").split()), *m[2:]) for i, m in enumerate(made[:6]) if len(m[1].split()) > 20]
    got = {r["doc_id"]: r for r in quality.rate(frame(spark, made + junk)).collect()}
    assert all(not got[j[0]]["kept"] for j in junk)
    clean = [got[m[0]] for m in made if not got[m[0]]["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)


def test_empty(spark):
    assert quality.rate(frame(spark, [])).collect() == []
    got = quality.rate(frame(spark, [(1, None) + (None,) * 9])).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"], r["log_perplexity"]) for r in got] == [(0, True, False, None)]


def test_texts_of_very_many_code_points(spark):
    """More different code points than an alphabet holds: counted and scored as in one piece."""
    rich = "".join(chr(0x4E00 + i % 20_000) + chr(0x20000 + i) for i in range(20_000))  # 40,000 different ones
    docs = spark.createDataFrame([(1, rich, "zh"), (2, rich[:1000], "zh"), (3, "a b c d e f g h i j k", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.rate(docs).collect()}
    assert set(got) == {1, 2, 3} and got[1]["n_words"] == 1 and got[1]["log_perplexity"] is not None
    joined = {r["doc_id"]: r for r in quality.rate(docs, model_bytes=0).collect()}
    assert all(abs(joined[i]["log_perplexity"] - got[i]["log_perplexity"]) < 1e-3 * abs(got[i]["log_perplexity"]) for i in got)
    points = quality.codes(rich)
    pieces = list(quality.runs(points))
    assert len(pieces) > 1 and np.array_equal(np.concatenate([p for p, _ in pieces]), points)
    for (before, _), (_, context) in zip(pieces, pieces[1:]):
        assert np.array_equal(before[-3:], context)
    alphabet = quality.Alphabet()
    assert alphabet.keys(*pieces[0]) is not None and len(list(quality.runs(points[:10]))) == 1
