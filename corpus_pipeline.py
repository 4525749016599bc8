"""A corpus made ready for training: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from specloom.llm import language_id
from specloom.llm.bin_packing import pack_documents
from specloom.llm.exact_dedup import drop_duplicates
from specloom.llm.names import unused
from specloom.llm.ngram_join import linked_rows
from specloom.llm.queries import BYTE_BPE, END_ID, SEQUENCE_TOKENS, language_model
from specloom.llm.suffix_dedup import remove_repeats
from specloom.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEAT_BYTES = 100


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; null texts, texts without letters and those far from all centroids go."""
    return language_id.keep_known(docs, language_model(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id."""
    return drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of word shingles, directly or through others, the one with the smallest id.

    Null ids come last; of rows with equal ids the text's hash decides. No text stands twice here: see
    :func:`exact_duplicates`.
    """
    own, text_hash = unused("_id", docs.columns), unused("_hash", docs.columns)
    linked = linked_rows(docs, NEAR_WORDS, NEAR_PERCENT)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = linked.groupBy("root").agg(F.min(rank).alias("_first")).select(
        F.col("_first.id").alias(own), F.col("_first.text_hash").alias(text_hash)
    ).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(text_hash))
    return docs.join(first, same, "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that an earlier place of the corpus covers; a text may end up empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = remove_repeats(docs, REPEAT_BYTES, others=others)
    return left.select(
        *[
            F.col("kept").alias(c) if c == "text"
            else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col(c) if c == "doc_id"
            else F.col("others")[c].alias(c)
            for c in docs.columns
        ]
    )


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of tokens."""
    return pack_documents(docs, public_tokenizers.path(BYTE_BPE), END_ID, SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed_sequences),
]

#: Nearest centroids, component search and tokens are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
