from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm import mixing, packing, quality, secretscan, simhash
from plumbline.llm.common import WORD_RE
from plumbline.sources import scratch
from tests.llm.cases import frame, rows, texts
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups, plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    made = [m[:5] for m in rows(21, 90) if m[0] is not None][:-2]
    made += [(5000 + i, t, "en", "a", len(t)) for i, t in enumerate(texts(22, 40)) if len(t.split()) > 25]
    made.append((9000, made[0][1] + " password = hunter22 " + made[1][1], "en", "b", 1))
    sf = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows_in = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        out.append((rows_in, docs.collect(), docs.columns))
    return sf, out


def test_columns(stages):
    assert all(columns == COLUMNS for _, _, columns in stages[1][:-1])


def test_quality_stage(spark, stages):
    before, after, _ = stages[1][0]
    kept = Counter(r["doc_id"] for r in quality.rate(spark.createDataFrame(before, spark.read.parquet(f"{stages[0]}/documents.parquet").schema)).filter("kept").collect())
    assert Counter(r["doc_id"] for r in after) == kept and set(after) <= set(before)


def test_near_duplicate_stage(stages):
    before, after, _ = stages[1][1]
    label = groups([plain(r["text"]) for r in before])
    want = {min(r["doc_id"] for r, x in zip(before, label, strict=True) if x == y) for y in label}
    assert sorted(r["doc_id"] for r in after) == sorted(want) and set(after) <= set(before)


def test_secret_stage(stages):
    before, after, _ = stages[1][2]
    by = {r["doc_id"]: r for r in after}
    assert len(after) == len(before) and any(secretscan.scan_text(r["text"]) for r in before)
    for r in before:
        assert by[r["doc_id"]]["text"] == secretscan.redact_text(r["text"], secretscan.scan_text(r["text"]))


def test_mixing_stage(spark, stages):
    before, after, _ = stages[1][3]
    size = lambda t: len(WORD_RE.findall(t))
    docs = spark.read.parquet(f"{stages[0]}/2")
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(docs)).collect()}
    got = Counter()
    for r in after:
        got[r["doc_id"]] += size(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_packing_stage(spark, stages):
    before, after, _ = stages[1][4]
    pieces = packing.pack(spark.read.parquet(f"{stages[0]}/3")).collect()
    check([(r["doc_id"], r["text"]) for r in before], [p.asDict() for p in pieces], 2048)
    assert Counter(p["sequence_id"] for p in pieces) == Counter(r["sequence_id"] for r in after)


def test_run_and_rerun(spark, stages):
    one, two = (corpus_pipeline.run(spark, stages[0]).drop("sequence_id", "offset").collect() for _ in range(2))
    total = lambda rows: Counter({d: n for d, n in _lengths(rows).items()})
    assert total(one) == total(two) == total(stages[1][-1][1])


def _lengths(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r["length"]
    return out


def test_stages_of_odd_and_empty_tables(spark):
    for made in (rows(23, 20), []):
        docs = frame(spark, made)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() >= 0, name
    assert simhash.drop_near_duplicates(frame(spark, rows(23, 20))).count() > 0


def test_texts_are_not_shuffled(spark, tmp_path):
    """Near-dedup and mixing send row numbers to the texts, in plans and in what is written before them."""
    frame(spark, rows(25, 60, odd=False)).select(*COLUMNS).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for out in (simhash.drop_near_duplicates(docs), mixing.documents(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if " Exchange " in line:
                below = next(x for x in lines[i + 1 :] if "Project" in x or "Scan" in x or "Aggregate" in x or "Arrow" in x)
                assert "text#" not in below, (line, below)
        assert out.count() > 0


def test_scratch_files_go(spark, stages, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_OWN", [str(tmp_path)])
    chunked = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("plumbline_chunks")}
    corpus_pipeline._tidy(spark, spark.createDataFrame([], "doc_id long"))
    others = chunked()
    assert corpus_pipeline.run(spark, stages[0]).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left <= {"mixing-sources"}, left  # what the result itself reads
    corpus_pipeline._tidy(spark, spark.createDataFrame([], "doc_id long"))
    assert not list(tmp_path.iterdir())
    assert chunked() == others


def test_repeated_rows_in_the_mix(spark):
    made = [m[:5] for m in rows(26, 30, odd=False)]
    docs = spark.createDataFrame(made + made[:3] + [(made[0][0], made[0][1], "zz", made[0][3], 5)], "doc_id long, text string, lang string, source string, n_chars int")
    once, again = (Counter(mixing.documents(docs.repartition(n), block_words=8, stream_docs=10, shard_slots=64).select("doc_id", "text").collect()) for n in (2, 5))
    assert once == again
    with pytest.raises(ValueError):
        mixing.documents(docs.withColumn("__row", docs.doc_id))
