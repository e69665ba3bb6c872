"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, table, tokenizer_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import prefix_tree, read_back

    bounded_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turns = ((0, "user"), (1, "assistant"))
    added = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in turns))).alias("x"),
    )
    added = added.select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text"))
    return read_back(*prefix_tree(rows.unionByName(added))).drop("n_segments")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import transactions, write_archives

    bounded_batches(spark)
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return transactions(spark, path).drop("capture")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    bounded_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import near_copies, rendered

    bounded_batches(spark)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = near_copies(rendered(vectors), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digest_documents

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return digest_documents(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    bounded_batches(spark)
    return extract(table(spark, sf_dir, "pages"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import PASSAGE, removal_digests

    bounded_batches(spark)
    return removal_digests(table(spark, sf_dir, "documents"), keep="none", passage=PASSAGE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_chat_format": op2_chat_format,
        "op3_warc": op3_warc,
        "op4_simhash": op4_simhash,
        "op5_packing": op5_packing,
        "op6_media_copies": op6_media_copies,
        "op7_quality_rules": op7_quality_rules,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_html_text": op9_html_text,
        "op10_suffix_array": op10_suffix_array,
    }


def oracle_sql() -> dict[str, str]:
    """For the rest, tests compare with plain versions."""
    from . import oracles

    return {
        "op2_chat_format": oracles.CHAT,
        "op3_warc": oracles.WARC,
        "op7_quality_rules": oracles.QUALITY,
    }
