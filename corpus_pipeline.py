"""The corpus pipeline: documents through five operators, each working on all that its predecessor kept.

toxicity: documents that score as toxic go. line dedup: later copies of repeated passages go from the
texts, and with them the documents that nothing is left of. near
duplicates: one document of each group stays. personal data: spans are replaced by their kind. packing: the texts as
sequences of token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import line_dedup, packing, personal, toxicity
from tracewright.llm.near_duplicates import near_duplicates, only
from tracewright.llm.shared import settled, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose all their words (all of it stands earlier) go."""
    return line_dedup.without_repeats(docs, drop_emptied=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one doc_id stay or go together; rows of null doc_id stay."""
    groups = near_duplicates(docs)
    return only(docs, groups.where("not kept").select("doc_id"), how="left_anti").select(docs.columns)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates_stage),
    ("personal data", personal_stage),
    ("packing", packing_stage),
]
#: Learned weights, hashed signatures and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written in the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
