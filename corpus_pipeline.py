"""From raw documents to packed sequences: language, near duplicates, repeated strings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import materialize, table
from tessella.llm.language import with_known_language
from tessella.llm.minhash import without_near_duplicates
from tessella.llm.packing import pack
from tessella.llm.suffix import without_repeated_bytes
from tessella.llm.tokens import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without letters and those between two languages go.

    Null and empty texts have no letters and go. Long texts are judged whole. Rows that repeat each other or a doc_id,
    and rows with null doc_id, are judged each by itself. A null lang becomes the predicted one. Columns of any name
    stay. Empty table: no rows.
    """
    return with_known_language(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id: shingles of five words, similarity 0.8.

    Texts that are null or have no words are near nothing and stay. Long texts are compared by their whole sets. Of
    rows with one doc_id the first by text stays; rows without doc_id all stay. Columns of any name stay. Empty table:
    no rows.
    """
    return without_near_duplicates(docs, width=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that are there more than once; n_chars is counted anew.

    Null texts stay null, shorter ones as they are; a text that loses everything is empty. Long texts are looked at
    whole, in segments. Rows that repeat each other lose what they share. Columns of any name stay. Empty table: no rows.
    """
    return without_repeated_bytes(docs, 200)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens.

    Null and empty texts are the end id alone. Documents of any length are cut into pieces. Repeated rows and null
    doc_ids are documents like others. Only doc_id and text are looked at. Empty table: no rows.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses none of the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
