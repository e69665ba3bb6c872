"""A training corpus from documents: quality rules, near-dedup, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet to the shared
folder and read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import nearcopies
from lodestar.llm.common import bounded_batches, cut, table, tokenizer_path
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import keep_good
from lodestar.llm.repeats import PASSAGE, remove_repeats
from lodestar.llm.secrets import redact
from lodestar.llm.simhash import deduplicate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity of 0.8 or more): that with the
    smallest doc_id. Operator 4's radius of 3 bits is its query's contract and misses most of these."""
    bounded_batches(spark)
    return deduplicate(docs, nearcopies.components)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of over 50 words; the first copy stays. Operator 10's 400 bytes
    are its query's contract and would leave most of these."""
    bounded_batches(spark)
    return remove_repeats(docs, PASSAGE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences."""
    bounded_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), forget=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: No stage's result can be told in SQL as a whole (learnt cutoffs, components, tokens).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = cut(docs, name)
    return docs
