"""Registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, embed_dedup, line_dedup, mixing, variants
from .common import table
from .html_text import extract_text
from .phrases import edited_fingerprints
from .secret_scan import scan_secrets, secret_digest
from .sharding import shard_rows
from .simhash import simhash_groups
from .tokens import token_files
from .toxicity import toxicity_scores
from .variants import spelling_variants


def tokenizer_path() -> str:
    """The public byte-level tokenizer, installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``embeddings`` at cosine 0.95."""
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all ``documents``."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, k=5)


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all ``documents``."""
    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID files of all ``documents``, written and read back."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``, site templates removed."""
    return extract_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probabilities of all ``documents``."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability", "margin_error")})


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``, weak parts linked."""
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without lines that stand on many sources."""
    return line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all ``documents``."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of all ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=30, cover=80, top=2000)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``."""
    return spelling_variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, noise=199, ratio=5)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_token_files": op5_token_files,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": embed_dedup.oracle_sql(),
    "op3_decontamination": decontam.oracle_sql(),
    "op7_mixing": mixing.oracle_sql(),
    "op9_line_dedup": line_dedup.oracle_sql(),
    "op12_collocations": collocations.oracle_sql(),
    "op13_spelling_variants": variants.oracle_sql(),
}
