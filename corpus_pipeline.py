"""From raw documents to packed sequences, in five stages.

quality classifier -> quality rules -> near duplicates -> secret scan -> packing.
Each stage is one operator of chunkweave.llm, works on all that the stage before
kept, and is written as Parquet and read again.  All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.minhash import keep_first
from chunkweave.llm.nbsvm import keep_good
from chunkweave.llm.packing import best_fit_packing
from chunkweave.llm.quality_rules import keep_passing
from chunkweave.llm.queries import vocabulary
from chunkweave.llm.secret_scan import redact_secrets
from chunkweave.session import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and all certified rules."""
    return keep_passing(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return keep_first(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in the text replaced by its kind; n_chars follows."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(clean.schema["n_chars"].dataType))) if "n_chars" in clean.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents, placed in sequences of at most 2048 tokens."""
    return best_fit_packing(spark, docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", packing),
]

#: No SQL: the classifier and the rules' thresholds are fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents below sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        Scratch.release(before)  # what the stage wrote on its way
        if k > 1:
            scratch.drop(f"stage-{k - 1}")
    return docs
