"""A training corpus from raw documents: select, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`; the last returns a row per piece of a packed sequence.
"""

from pyspark.sql import DataFrame, SparkSession

from basketlens.llm import chunk_dedup, mixing, near_dedup, packing, quality
from basketlens.llm.work import settled, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier doesn't reject; it learns from the rated ones among `docs`."""
    ratings = quality.ratings(table(spark, sf_dir, "labels"))
    return quality.accepted(docs, quality.fitted(docs, ratings, quality.GRADES))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return chunk_dedup.deduplicated(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights, in random order."""
    return mixing.mixed(docs, marks=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023  called at once
    return STAGES[-1][1](spark, docs, sf_dir)
