"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm import (
    chat_format,
    decontaminate,
    divergence,
    embedding_dedup,
    language_id,
    license_scan,
    line_dedup,
    main_text,
    minhash_dedup,
    oracles,
    packing,
    pii_surrogates,
    sharding,
    spelling,
)
from fieldlark.llm.common import secret_key, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_surrogates.Surrogates(secret_key(spark)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(chat_format.chat_format(chat_format.with_text_parts(turns.unionAll(extra))))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shards(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), minhash_dedup.MinHash(words=3, threshold=85))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own: list[Query] = [
        op1_license_scan,
        op2_embedding_near_dedup,
        op3_pii_surrogates,
        op4_substring_dedup,
        op5_sequence_packing,
        op6_chat_format,
        op7_benchmark_decontamination,
        op8_balanced_sharding,
        op9_minhash_near_dedup,
        op10_language_id,
        op11_spelling_variants,
        op12_html_extraction,
        op13_source_divergence,
    ]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": oracles.license_sql(license_scan.Scan()),
        "op2_embedding_near_dedup": oracles.EMBEDDINGS,
        "op6_chat_format": oracles.CHAT,
        "op9_minhash_near_dedup": oracles.NEAR_DUPLICATES,
        "op11_spelling_variants": oracles.spelling_sql(spelling.Spelling()),
        "op12_html_extraction": oracles.MAIN_TEXT,
        "op13_source_divergence": oracles.divergence_sql(divergence.Audit()),
    }
