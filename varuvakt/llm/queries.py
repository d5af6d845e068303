"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varuvakt.llm import check_texts
from varuvakt.llm.registry import ORACLES, QUERIES, register, table

__all__ = ["ORACLES", "QUERIES"]


@register("op8_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from varuvakt.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@register("op2_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register(
    "op4_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
 CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@register("op10_urls")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.urlfilter import verdicts

    return verdicts(table(spark, sf_dir, "pages"))


@register("op7_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@register("op9_licenses")
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("detections")


@register("op1_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from varuvakt.llm.sentencepiece import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op5_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


@register("op6_hmm")
def hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.hmm import score

    return score(table(spark, sf_dir, "documents"))


@register("op3_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.fingerprint import fingerprints as operator

    return operator(table(spark, sf_dir, "documents"))


@register("op11_merkle", check_texts.merkle())
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.merkle import digests

    return digests(table(spark, sf_dir, "documents"))


@register("op12_embeddings")
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.multi_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op13_spelling", check_texts.spelling())
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varuvakt.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))
