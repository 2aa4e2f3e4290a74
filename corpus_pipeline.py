"""A training-data pipeline of five operators; see STAGES."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import tokens
from palimpsest.llm.common import cut_lineage
from palimpsest.llm.mixing import mix_rows
from palimpsest.llm.quality import keep_good
from palimpsest.llm.queries import VOCABULARY
from palimpsest.llm.secret_scan import redact
from palimpsest.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the least id."""
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask; all documents stay, n_chars follows the text."""
    columns = docs.columns
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mix_rows(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digests of ids and of the decoded bytes."""
    return tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, small=True).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

# SQL has neither the fingerprints' hash, nor the seeded pick, nor BPE; the tests
# hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents. Each result is written as Parquet
    in the shared checkpoint folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut_lineage(spark.range(1))  # names the shared folder where none is set
    shared = spark.sparkContext.getCheckpointDir()
    folder = os.path.join(shared, f"corpus-pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
