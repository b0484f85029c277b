"""The corpus pipeline: stages over ``documents``, each a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dups, lang_id, near_dups, packing, pii
from tidemark.llm.frames import bounded_batches, keep, remove, without

#: Packing and the two kinds of spans have no SQL form; tests compare with brute force.
ORACLE_SQL = None

#: Bytes of words that a worker remembers in packing, beside the ids that pass through it.
WORD_BYTES = 8 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that identification does not reject, with the predicted
    ``lang`` where it was null or blank.

    Null texts and texts without a letter go; if no row has a usable label, nothing is
    filled. Repeated rows are judged one by one, long texts as a whole, equal chances go to
    the language that sorts first; an empty table stays empty; other columns pass."""
    bounded_batches(spark)
    return lang_id.settle(docs, lang_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id.

    Null and empty texts are equal; of rows that repeat the largest id one stays. Long texts
    are compared whole; an empty table stays empty; other columns pass."""
    bounded_batches(spark)
    return without(docs, exact_dups.exact_duplicates(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Texts without words are copies of each other; of rows that repeat the smallest id one stays,
    and a null id only where all of a group are null. Long texts count whole; an empty table
    stays empty; other columns pass."""
    bounded_batches(spark)
    return without(docs, near_dups.near_duplicates(docs, words=4, max_bits=4))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced; ``n_chars`` follows the text.

    A null text stays null with its ``n_chars``; rows are treated one by one, so repeats and ties
    change nothing; long texts are read whole; an empty table stays empty; other columns pass."""
    bounded_batches(spark)
    clean = pii.redact(docs, pii.train_on(pii.labelled_table(spark)))
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows, one row each, with their ids.

    A null or empty text is one token; rows that repeat are packed one by one; long texts are
    cut into several pieces; an empty table gives no pieces; other columns end here."""
    bounded_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=WORD_BYTES)
    return pieces.withColumnRenamed("value", "ids")


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; the result of the last, read from the shared folder.

    The table of a stage is deleted once the next one is written. Odd rows fare as the stages
    say; an empty table gives no pieces."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage_{name}")
        if before is not None:
            remove(before)
        before = docs
    return docs
