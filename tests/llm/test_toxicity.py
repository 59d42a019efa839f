import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm import toxicity
from tests.llm.cases import frame, rows, texts

BAD = ["dreadful", "wretch", "horrid", "vermin"]


def labelled(n=600):
    rng = random.Random(9)
    made, marks = [], []
    for i, text in enumerate(texts(5, n, copies=0)):
        toxic = int(rng.random() < 0.3)
        words = text.split() + ["the"] * 10
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        made.append((i, " ".join(words)) + (None,) * 9)
        marks.append((i, 1, toxic))
    return made, marks


def test_held_out_accuracy(spark):
    made, marks = labelled()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, made), labels).collect()
    toxic = {i: t for i, _, t in marks}
    assert len(got) == len(made)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    hits = [r for r in held if r["predicted"]]
    assert sum(toxic[r["doc_id"]] for r in hits) >= 0.95 * len(hits)
    assert len([r for r in hits if toxic[r["doc_id"]]]) >= 0.9 * sum(toxic[r["doc_id"]] for r in held)


def test_held_out_labels_do_not_matter(spark):
    made, marks = labelled(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    run = lambda m: sorted(map(tuple, toxicity.toxicity(frame(spark, made), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect()))
    assert run(marks) == run(turned)


def test_odd_rows_and_labels(spark):
    made, marks = labelled(120)
    made = [(m[0] + 10_000, *m[1:]) for m in made] + rows(1, 5)
    marks = [(i + 10_000, q, t) for i, q, t in marks] + [(10_000, 1, 1), (0, None, None), (None, 1, 1), (77_777, 1, 1), (10_003, 0, 7)]
    got = toxicity.toxicity(frame(spark, made), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(made) and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_without_both_classes(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(frame(spark, rows(1, 5)), labels).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), labels).collect() == []


def test_quoting_documents_do_not_hide_markers():
    """Ordinary documents that quote the toxic words exclude none from the dictionary, which is fitted on the even ones."""
    made, marks = labelled()
    texts = [[m[1] for m, (_, _, t) in zip(made, marks, strict=True) if t == kind] for kind in (1, 0)]
    texts[1][:20:2] = [t + " " + " ".join(BAD) for t in texts[1][:20:2]]
    judge = toxicity.learn(*texts, 0.3, window=2, dict_bytes=16384, base_bytes=8192, false_share=0.005)
    of = judge.open()
    found = [[judge.score(judge.gains(t, of)) >= 0.7 for t in own] for own in (texts[0], texts[1][20:])]
    assert sum(found[0]) >= 0.9 * len(found[0]) and sum(found[1]) <= 0.02 * len(found[1])


def test_a_long_document_does_not_end_the_sample(spark):
    """The document that comes first in the order of the sample is longer than all that may be read."""
    made, marks = labelled(200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    may = labels.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1 AND toxic = 0")
    first = may.orderBy(F.xxhash64(F.lit(11), "doc_id")).first()["doc_id"]
    made[first] = (first, "plain words only " * 30_000, *made[first][2:])
    judge, _ = toxicity.train(
        frame(spark, made), labels, train_chars=400_000, window=2, dict_bytes=16384, base_bytes=8192, false_share=0.005
    )
    assert judge is not None
