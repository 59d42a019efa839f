"""The registered queries of the operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import archive, forest, mixing, packing, quality, repair, secretscan, simhash, substring, tokencount, topk, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op5_warc_bundles"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT p.page_id, p.html, f.first, sha1(p.html) AS h FROM p JOIN f USING (html))
SELECT page_id, strlen(html) AS payload_bytes,
  translate(to_base(('0x' || h[1:10])::BIGINT, 32, 8) || to_base(('0x' || h[11:20])::BIGINT, 32, 8)
    || to_base(('0x' || h[21:30])::BIGINT, 32, 8) || to_base(('0x' || h[31:40])::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rated.select("doc_id", *quality.MEASURES, "base_failed", "kept", "log_perplexity")


@query
def op9_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL["op10_block_anchors"] = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents
), g AS (
  SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
r AS (
  SELECT DISTINCT doc_id, i + k AS at FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS k FROM g JOIN f USING (gram) WHERE g.doc_id > f.first)
), k AS (
  SELECT p.doc_id, list(p.word ORDER BY p.at) FILTER (WHERE r.at IS NULL) AS kept, count(r.at) AS n_removed
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w) p LEFT JOIN r ON p.doc_id = r.doc_id AND p.at = r.at
  GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


@query
def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = forest.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return forest.neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.nodes(trie.prefixes(trie.rebuilt(own)))


SQL["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
i AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda j: ascii(substr(s, j::INT, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
  ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), r AS (
  SELECT i.conv_id, 0 AS part, o.pos, o.k, o.words FROM i JOIN o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL SELECT o.conv_id, 1, o.pos, o.k, o.words FROM o JOIN i USING (conv_id) WHERE o.pos > i.h
), s AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
p AS (
  SELECT conv_id, depth, words, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM i
), q AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(path) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM p
), n AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY path
), c AS (SELECT parent AS path, count(*) AS n_children FROM n GROUP BY parent),
m AS (
  SELECT q.path, sum((n.n_convs - 1) * n.words) AS saved, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM n LEFT JOIN c USING (path) JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  CAST(m.n_leaves AS BIGINT) AS n_leaves, CAST(m.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN c USING (path) JOIN m USING (path) LEFT JOIN n u ON u.path = n.parent"""
