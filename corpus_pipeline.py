"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.decontamination import clean_documents
from dossier.llm.language_id import accepted_documents
from dossier.llm.mixing import mixed_documents
from dossier.llm.near_dedup import deduplicated_documents
from dossier.llm.scratch import stored
from dossier.llm.sharding import shard_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised with enough confidence, all columns as they are.

    Texts that are null or without a letter go; so does everything if no row has a text and lang to learn from.  Equal
    texts are judged alike, whatever their other columns.
    """
    return accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, all columns as they are.

    Of rows that share that doc_id one stays.  Rows without a doc_id stay, as do null texts and those without a word: they
    are in no group.
    """
    return deduplicated_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are.

    Null and empty texts hold nothing, and null and empty items are nowhere; repeated rows are judged alike.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy, in training order, which the next stage reads off the files.

    A null source is a source, a null text has size 0, a null doc_id sorts as the empty string; repeated rows are
    documents of their own; no rows give none.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix, slots in the order of training.

    Equal rows have slots of their own; a null doc_id is a key like another, a null text is empty; no rows give none.
    """
    return shard_rows(docs, as_read=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Language ID, near-dedup and decontamination can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
