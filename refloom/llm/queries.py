"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import decontam, fingerprint, hardneg, htmltext, langid, licenses, lmscore, neardup, packing, quality, toxicity, turntrie, vecdup
from refloom.llm.base import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_copies(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_languages(docs))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), label.alias("label")), F.col("vec_id") % 50 == 0)


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    arrays = turntrie.turn_arrays(table(spark, sf_dir, "conversations"))
    return turntrie.prefix_trie(turntrie.rebuild(arrays, c - c % 100, (F.crc32(c.cast("string")) % 6).cast("int"), 5))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality, op2_near_duplicates, op3_fingerprints, op4_toxicity, op5_licenses, op6_lm_scores, op7_decontamination, op8_packing, op9_languages, op10_page_text, op11_hard_negatives, op12_turn_trie, op13_near_vectors)
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

_OP6 = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS w, unnest(list_concat([''], w[1:len(w)-1])) AS v FROM words WHERE len(w) > 0),
one AS (SELECT w, count(*) AS n FROM tokens GROUP BY w UNION ALL SELECT '', count(*) FROM words WHERE len(w) > 0),
two AS (SELECT v, w, count(*) AS n FROM tokens GROUP BY v, w),
types AS (
  SELECT two.v, two.w, CASE WHEN two.n >= 2 THEN ln(two.n / c.n) ELSE ln(0.4 * o.n / (SELECT count(*) FROM tokens)) END AS s
  FROM two JOIN one c ON c.w = two.v JOIN one o ON o.w = two.w)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, round(x.score, 6) AS score
FROM words d LEFT JOIN (SELECT doc_id, avg(s) AS score FROM tokens JOIN types USING (v, w) GROUP BY doc_id) x USING (doc_id)
"""

_OP7 = r"""
WITH w7 AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s7 AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w7 WHERE len(w) >= 5),
n7 AS (SELECT id, count(*) AS n FROM s7 WHERE kind = 1 GROUP BY id),
m7 AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS m FROM s7 d JOIN s7 i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY d.id, i.id)
SELECT doc_id, item_id, n AS n_item_shingles, m AS n_shared, m / n AS containment FROM m7 JOIN n7 ON n7.id = m7.item_id WHERE m >= 0.8 * n
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"

_OP12 = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
made AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
heads AS (SELECT conv_id, unnest(range(0, len(t) + 1)) AS depth, t FROM made),
steps AS (SELECT conv_id, depth, t[1:depth] AS path, depth = len(t) AS ends, coalesce(length(t[depth].t), 0) AS size FROM heads),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY path, depth),
up AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS c, depth - 1 AS d, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.c = up.conv_id AND kids.d = up.depth),
below AS (SELECT conv_id, depth, unnest(range(0, depth + 1)) AS d, path, (n_convs - 1) * size AS saved, n_children = 0 AS leaf FROM full_),
sums AS (SELECT path[1:d] AS path, d, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM below GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s ON s.path = f.path AND s.d = f.depth
"""

_OP13 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.vec_id)
SELECT r.vec_id, coalesce(any_value(k.n), 0) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept
FROM reach r LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = r.vec_id GROUP BY r.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": _OP2, "op6_lm_scores": _OP6, "op7_decontamination": _OP7, "op11_hard_negatives": _OP11, "op12_turn_trie": _OP12, "op13_near_vectors": _OP13}
