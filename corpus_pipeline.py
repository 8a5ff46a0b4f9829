"""The training-corpus pipeline: five stages over ``documents``, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from sluiceway.llm.queries import tokenizer_path
from sluiceway.llm.runtime import Scratch, made, release, table

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from all labels of this corpus."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return jaccard.drop_near_copies(docs, k=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), their number, and the digest of the text decoded from them, for each document."""
    return bpe.encode(docs, tokenizer_path(), with_decoded=True).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_first_copies),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("BPE encoding and decoding", encode),
]

#: A fitted classifier and an encoder have no SQL; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark, before = made(), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{k}")
            # nothing reads the stage's own tables, or its input, any more
            release(mark)
            scratch.drop(before)
    return docs
