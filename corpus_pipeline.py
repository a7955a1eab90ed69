"""Corpus pipeline: quality rules, language identification, near-duplicate removal and packing.

Each stage works on all rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcast.llm import langid, packing, quality, simhash
from fieldcast.llm.common import stored, table
from fieldcast.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does not fail most of the time. NULL and empty texts have no words
    and go; a NULL source is a host of its own; repeated rows count and stay as often as they stand; no rows give none."""
    return quality.keep(docs)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised. Texts that are NULL or without a letter go, repeated rows are judged
    alike; without labelled rows nothing can be recognised and nothing stays."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; only in a group without any id one
    without. Repeated rows are a group; texts without a word are one group; no rows give none."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 1,024 ids. NULL texts are empty ones; texts of any length
    are cut into full sequences first; repeated rows and rows without doc_id are packed one by one; no rows give none."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("language identification", language_identification),
    ("simhash near-duplicates", near_duplicates),
    ("packing", packed),
]

#: Language models, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
