"""From raw documents to packed training sequences, in five stages.

Each stage gets all documents that the one before kept, written as Parquet and read again, so a lost
executor costs at most one stage's tasks.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import line_dedup, minmax_dedup, packing, quality_ftrl, quality_rules
from chronoframe.llm.queries import tokenizer_path
from chronoframe.llm.storage import documents, settled


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs, quality_rules.fit(docs, quality_rules.trusted_ids(_labels(spark, sf_dir))))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half go.

    It is fitted on the labelled raw documents, since the rules have taken most bad examples out of ``docs``.
    """
    return quality_ftrl.keep(docs, quality_ftrl.fit(documents(spark, sf_dir), _labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    out = line_dedup.dedup(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return minmax_dedup.keep(docs, k=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("best-fit packing", pack)]

#: SQL can't express the fitted models nor the packing; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` of the folder; a stage's working tables go when its result is written."""
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = settled(spark, "stage-" + name.replace(" ", "-"), lambda stage=stage, docs=out: stage(spark, docs, sf_dir))
    return out
