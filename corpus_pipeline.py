"""A training corpus from raw documents: five stages, each over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives
the rows that stay, with the columns of documents (the last: packed pieces). docs
is a table.

In every stage: a null text counts as empty; the stages that choose rows give back
nulls, extra columns and whole texts as they were; ids may be null or repeated; an
empty table gives an empty one. What ties, repeated rows and very long texts give is
said in the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm import content_sort, near_dup, packing, pii, quality_fm
from scenaria.llm.common import Scratch
from scenaria.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; repeated rows are judged alike. Labels are learned from labels.parquet."""
    return quality_fm.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one row stays: the longest, then that of the least id (null last)."""
    return content_sort.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts one row stays, that of the least id (null last)."""
    ship(spark)
    return near_dup.near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, addresses and dates become pseudonyms; n_chars follows where a text got longer or shorter.

    The key is the setting spark.scenaria.pii.key, or one of the session's own.
    """
    out = pii.pseudonymise(docs, pii.session_key(spark))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a repeated row is packed as often as it occurs."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: The classifier, Order MinHash and the tokenizer are beyond SQL; a test compares every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
            scratch.drop(before)
        # the pieces are a table of their own, so the last stage reads docs before this block ends
        return STAGES[-1][1](spark, docs, sf_dir)
