"""Training-data pipeline over ``documents``: STAGES applied one after another.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes it as
Parquet in the shared folder and the next stage reads it from there, so a lost
executor never costs more than a stage. All but the last return the columns of
``documents``; the last writes token files and returns one row per document in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from echoset.llm.common import prepare, table
from echoset.llm.decontam import decontaminate
from echoset.llm.mixing import sample_documents
from echoset.llm.queries import tokenizer_path
from echoset.llm.simhash import simhash_dedup
from echoset.llm.tokens import token_files
from echoset.llm.toxicity import drop_toxic

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go (operator 1)."""
    return drop_toxic(docs, table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (operator 10)."""
    prepare(spark)
    return simhash_dedup(docs, shingle=3, radius=2).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go (operator 3)."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by probabilities raked to the target mix (operator 7)."""
    prepare(spark)
    return sample_documents(docs).select(*DOCUMENT_COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files, and one row per document read from them (operator 5)."""
    prepare(spark)
    return token_files(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", tokens),
]

ORACLE_SQL = None  # boosted trees, fingerprints and tokenizers are beyond SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
