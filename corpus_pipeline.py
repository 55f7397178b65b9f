"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Defined cases, for all stages: an empty table stays empty; further columns, whatever their names, pass through the first
four stages as they are. A null text has no words, so the first stage rejects it, as it does empty ones; a null doc_id is
no reason to go, and rows without one are told apart by their texts; rows that share a doc_id are judged by their own
texts. Rows equal in id and text are one document to the near-duplicates stage, which keeps one of them. A text of any
length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldfold.llm import decontaminate, packing, pii, quality_rules, simhash
from fieldfold.llm.common import documents, drop, materialise, table
from fieldfold.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; with no usable labels only the base rule decides."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, alike by 0.8 or more) stays: that of the smallest
    doc_id, a null one first, and of rows that share it that of the least text hash."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark (10 words, or a whole shorter item) go; an empty benchmark takes none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; a null text stays null, and n_chars is counted anew."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences, in curve order: every token of every row that is left, the end id of an empty text too."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 1)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned rules, fingerprints and a trained tagger are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)  # the stage before's table; never the input
    return docs
