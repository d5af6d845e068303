"""From raw documents to packed sequences: drop poor texts, keep one of each group of near duplicates, take out secrets, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varuvakt.llm.common import stored
from varuvakt.llm.packing import pack
from varuvakt.llm.quality import keep_good
from varuvakt.llm.secrets import redact
from varuvakt.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go, each by its own text; null and empty texts and rows without doc_id stay. No rows give no rows."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; texts that share a doc_id are told apart; rows without doc_id stay."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with the secrets taken out of their texts; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: A trained classifier and a tokenizer are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
