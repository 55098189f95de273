"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import bpe, line_dedup, lm_score, minmax_dedup, packing, quality_ftrl, quality_rules, token_files, toxicity, vptree
from chronoframe.llm.storage import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(documents(spark, sf_dir), k=3, num=85, den=100)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_ftrl.score(docs, quality_ftrl.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, quality_rules.fit(docs, quality_rules.trusted_ids(labels)))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_lm_score, op3_pack, op4_near_duplicates, op5_quality, op6_bpe, op7_toxicity, op8_nearest, op9_token_files, op10_quality_rules)}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP1_SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
n AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM k),
g AS (SELECT key, min(doc_id) AS first FROM n WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM n LEFT JOIN g USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL}
