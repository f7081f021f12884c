"""The corpus pipeline: language, near duplicates, decontamination, mixing, shards.

Each stage calls one operator of ``tokenloom.llm`` on all rows that the stage before has
kept. All but the last return the columns of ``documents``; the last adds ``shard`` and
``slot``. SQL cannot express the hashing stages, so there is none for the whole; tests
compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import stored, table
from tokenloom.llm.decontaminate import without_items
from tokenloom.llm.language import identify, learn_text_model, with_known_language
from tokenloom.llm.mixture import mix
from tokenloom.llm.near_duplicates import one_of_each_group
from tokenloom.llm.registry import ready
from tokenloom.llm.shards import shuffle_into_shards

SHARDS = 16
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided by text, declared language and source stay.

    Null and blank texts have none and go. Where no row has a usable label there is nothing to
    decide by, and all rows stay.
    """
    ready(spark)
    model = learn_text_model(docs, "doc_id", "text", "lang")
    if not model.languages:
        return docs
    found = identify(docs, model, "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    return with_known_language(docs, found, "doc_id", F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; null and blank texts are in no group."""
    ready(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay; items below the least length are not looked for."""
    ready(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until their sources reach their targets; a null source is one."""
    ready(spark)
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, null and empty ones too, are shuffled into shards of exact sizes."""
    ready(spark)
    return shuffle_into_shards(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
