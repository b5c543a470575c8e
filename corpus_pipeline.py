"""A training corpus from documents: quality rules, line dedup, near-dedup, decontamination, mixing.

All stages but the last take documents and return documents, in the columns they came with. Nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns have the results that the stage's operator states:

- quality_rules drops documents that the policy rejects; a null or empty text has no words and goes.
- line_dedup changes text and n_chars only; no document goes, and one of boilerplate only is left with an empty text.
- near_dedup keeps the least doc_id of each class; rows that repeat an id and a text are one document, null texts stay.
- decontaminate drops documents that hold a test item; null and empty texts stay.
- mix_sources packs the words of what is left into blocks and returns the mixed training text, one row per slot: shard, slot, source,
  block, doc_ids, n_words, text. A document without words is in no block.

An empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import decontam, linededup, mixing, neardup, quality
from engramlake.llm.common import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_text(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The alignment scores, the signatures and the draws are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed training text of documents; each stage's result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
