"""Readings that put the actor back in: proven actors, pet items, debuts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, EngineConfig
from .hype import KEY, cohort_since_epoch
from .scope import last_day


def top_finish(cfg: EngineConfig):
    return (F.col("stratum") == CHALLENGE) & F.coalesce(
        F.col("placement") <= cfg.proven_placement, F.lit(False)
    )


def proven_actors(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Actors with enough challenge finishes above the cut between the epoch
    start and the end of the baseline window."""
    played = cohort_since_epoch(baskets, cfg)
    end = F.date_sub(last_day(played), cfg.fresh_days)
    return (
        played.where(top_finish(cfg) & (F.col("date") <= end))
        .groupBy("actor")
        .agg(F.count("*").alias("finishes"))
        .where(F.col("finishes") >= cfg.proven_finishes)
    )


def pet_items(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Configurations registered often, by very few actors.

    Counts alone find them, so the actors are looked up only for configurations
    that have so few, and none is gathered for one the whole field plays.
    """
    per_actor = (
        cohort_since_epoch(items, cfg)
        .where(F.col("segment").isin(*cfg.segment_names))
        .groupBy(*KEY, "actor")
        .agg(
            F.count("*").alias("lists"),
            F.count_if(top_finish(cfg)).alias("finishes"),
            F.min("date").alias("since"),
        )
    )
    pets = (
        per_actor.groupBy(*KEY)
        .agg(F.sum("lists").alias("appearances"), F.count("*").alias("owners"), F.min("since").alias("appeared_on"))
        .where((F.col("appearances") >= cfg.pet_appearances) & (F.col("owners") <= cfg.pet_actors))
        .drop("owners")
    )
    proven = proven_actors(baskets, cfg).select("actor", F.lit(True).alias("is_proven"))
    dissents = F.coalesce(F.col("is_proven") & (F.col("finishes") > 0), F.lit(False))
    told = (
        per_actor.select(*KEY, "actor", "finishes")
        .join(pets, list(KEY))
        .join(proven.hint("merge"), "actor", "left")
        .withColumn("dissents", dissents)
    )
    return (
        told.groupBy(*KEY, "appearances", "appeared_on")
        .agg(
            F.array_sort(F.collect_list("actor")).alias("actors"),
            F.array_sort(F.collect_list(F.when(F.col("dissents"), F.struct("actor", "finishes")))).alias("dissenters"),
            F.bool_or(F.col("dissents") & (F.col("finishes") >= cfg.proven_finishes)).alias("hypothesis_candidate"),
        )
        .select(
            F.lit("pet-tech").alias("kind"), *KEY, "appearances", "actors", "appeared_on", "dissenters",
            "hypothesis_candidate",
        )
    )


def debuts(baskets: DataFrame) -> DataFrame:
    """The first day each actor published at all."""
    return baskets.groupBy("actor").agg(F.min("date").alias("debut"))


def first_registrations(items: DataFrame) -> DataFrame:
    """The first day each actor registered each item."""
    return items.groupBy("actor", "item").agg(F.min("date").alias("first"))
