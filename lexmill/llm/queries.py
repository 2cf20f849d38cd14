"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, jaccard, language, media, mixing, nearest, pages, quality, repeats
from lexmill.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(media.probe(media.store(table(spark, sf_dir, "documents"))))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.windows(rows.unionByName(more)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.where("vec_id % 50 = 0"), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_media_columns": op1_media_columns, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_suffix_dedup": op3_suffix_dedup, "op4_byte_bpe": op4_byte_bpe, "op5_mixing": op5_mixing, "op6_language_id": op6_language_id, "op7_html_text": op7_html_text, "op8_chat_windows": op8_chat_windows, "op9_quality": op9_quality, "op10_exact_top_k": op10_exact_top_k}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = {
    "op2_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS x FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.x = p.a),
c AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id), k AS (SELECT a AS doc_id, count(*) AS n FROM p GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, coalesce(k.n, 0) AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM s)
SELECT query_id, "rank"::INTEGER AS "rank", vec_id, score FROM r WHERE "rank" <= 5""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can say; the others are tested against brute force, round trips or held-out rows."""
    return dict(SQL)
