"""The queries of this subpackage's operators: ``opN_<name>`` and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages")).withColumnRenamed("record_id", "page_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skerry.llm.bpe import tokenise

    return tokenise(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.lm import score

    return score(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.secrets import secret_spans

    return secret_spans(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skerry.llm.token_files import tokenise_write_read

    return tokenise_write_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skerry.llm.alignment import align

    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.llm.repair import repair

    return repair(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_byte_bpe, op4_lm_scoring, op5_sharding, op6_secret_scans, op7_mixing, op8_ann_search, op9_license_scans, op10_simhash_near_dedup, op11_token_files, op12_token_alignment, op13_conversation_repair)}
#: The other operators fit models, draw at random, search approximately or hash by functions that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, uri, sha256(h) AS payload_digest, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, uri, payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM d"""
}
