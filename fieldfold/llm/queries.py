"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, level_windows, license_scan, oracles, packing, pii, quality_rules, sharding, simhash, suffix_ranks, token_store
from .common import documents, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Byte limit of a shard in op1: small enough for the smallest tables to split as well.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir).select("doc_id", "text"), SHARD_BYTES).drop("text")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), 2)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_ranks.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", out.n.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = level_windows.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", out.n.alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("doc", "k")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_token_store, op3_suffix_array_dedup, op4_simhash, op5_pii, op6_packing, op7_substring_dedup, op8_quality_rules, op9_license_scan, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": oracles.sharding(SHARD_BYTES), "op7_substring_dedup": oracles.SUBSTRINGS, "op10_decontamination": oracles.DECONTAMINATION}
