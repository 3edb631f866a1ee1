"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  A stage's result is written as Parquet and
read again as the next one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpi_spark.llm import bpe, decontam, neardup, pii, quality
from kpi_spark.llm.queries import rank_lines
from kpi_spark.llm.store import Tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return neardup.dedup(docs, Tables(spark, "dedup"), shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks replace personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text"), rank_lines())
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else tables.put(out, f"stage-{k}")
    return docs


#: SQL can't express the classifier and the encoder; tests compare stages with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
