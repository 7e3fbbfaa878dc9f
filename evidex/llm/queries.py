"""The queries of the training-data operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import read_table, remainder
from .embdup import near_vectors
from .langid import detect_languages
from .license import license_sql, scan_licenses
from .lm import lm_scores
from .mixing import mix_to_targets
from .neardup import near_duplicates
from .pii import pii_digest, pii_sql
from .topk import exact_topk
from .toxicity import toxicity_scores


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


#: All pairs that share a shingle; components by reachability.
OP7_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)
), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l
), r(id, reach) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u
), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains: the languages, learned from the rows that `labels` covers; all are to have as many tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return mix_to_targets(docs, docs, among=read_table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(read_table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return scores.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scores = toxicity_scores(docs, labels, remainder("doc_id", 5) != 0)
    return scores.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs.
OP9_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.vec_id < b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l
), k AS (SELECT u, count(*) AS n FROM e GROUP BY u
), r(id, reach) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u
), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT m.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, m.vec_id) AS component_id, coalesce(component_id, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN k ON k.u = m.vec_id LEFT JOIN c ON c.id = m.vec_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_languages(read_table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license, op2_mixing, op3_pii, op4_lm_score, op5_toxicity, op6_exact_topk, op7_near_dedup, op8_bpe_roundtrip, op9_embedding_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license": license_sql(), "op3_pii": pii_sql(), "op6_exact_topk": OP6_SQL, "op7_near_dedup": OP7_SQL, "op9_embedding_dedup": OP9_SQL}
