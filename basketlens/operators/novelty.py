"""Novelty: how little of the history before a day had seen an item.

History is read at the grain of item and day, which the calendar bounds however
many lists share a day, and never list by list.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shares import share
from .scope import day_number, last_day, since

def before_day(*keys: str):
    """Everything of a key on strictly earlier days."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(day_number()).rangeBetween(Window.unboundedPreceding, -1)


def history(frame: DataFrame, start: str) -> DataFrame:
    """Cohort and near-miss rows from a day on."""
    return since(frame, start).where(F.col("member") | F.col("near_miss"))


def novelty(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per item and day it was registered: its share of the cohort's lists on
    earlier days, and whether it is back after an absence.

    Near-miss rows are read against the history and never folded into it.
    """
    seen = (
        history(items, cfg.history_start)
        .groupBy("item", "date")
        .agg(F.count_if("member").alias("plays"))
    )
    before = before_day("item")
    plays = seen.select(
        "item", "date",
        F.coalesce(F.sum("plays").over(before), F.lit(0)).alias("plays_before"),
        F.max(F.when(F.col("plays") > 0, F.col("date"))).over(before).alias("seen_before"),
    )
    # One row per published day: the calendar bounds both the pass and the broadcast.
    days = (
        history(baskets, cfg.history_start)
        .groupBy("date")
        .agg(F.count_if("member").alias("lists"))
        .select("date", F.coalesce(F.sum("lists").over(before_day()), F.lit(0)).alias("lists_before"))
    )
    absent = F.datediff("date", "seen_before")
    returning = F.coalesce(absent >= cfg.return_absence_days, F.lit(False))
    read = plays.join(F.broadcast(days), "date").select(
        "item", "date", "plays_before", "lists_before",
        F.coalesce(share(F.col("plays_before"), F.col("lists_before")), F.lit(0.0)).alias("historical_adoption"),
        returning.alias("returning"),
        F.when(returning, absent).alias("absent_days"),
    )
    return read.withColumn(
        "fringe", F.col("returning") | (F.col("historical_adoption") < cfg.fringe_adoption)
    )


def fringe_flags(
    items: DataFrame, baskets: DataFrame, cfg: EngineConfig, read: DataFrame | None = None
) -> DataFrame:
    """One flag per segment and item that was fringe on some day of the fresh
    window, carrying the earliest appearance. Anchored on the cohort's last day.

    `read` is the novelty of these days if it stands already; it looks back only, so
    that of a longer history serves as well. The day is found at day grain; only that day's rows are then looked up among
    the facts, the smaller actor and list standing first.
    """
    cohort = since(baskets, cfg.history_start).where("member")
    start = F.date_sub(last_day(cohort), cfg.fresh_days)
    recent = since(items, cfg.history_start).where(F.col("member") & (F.col("date") > start))
    fringe = (novelty(items, baskets, cfg) if read is None else read).where(F.col("fringe") & (F.col("date") > start))
    reading = F.struct("date", "historical_adoption", "returning", "absent_days")
    raised = (
        recent.select("segment", "item", "date")
        .distinct()
        .join(fringe, ["item", "date"])
        .groupBy("segment", "item")
        .agg(F.min_by(reading, "date").alias("at"))
        .select("segment", "item", "at.*")
    )
    shown = F.struct("actor", "list_id", "event", "placement", "qty_a", "qty_b")
    keys = ["segment", "item", "date"]
    first = (
        recent.join(raised.select(*keys), keys).groupBy(*keys).agg(F.min(shown).alias("first"))
    )
    return raised.join(first, keys).select(
        F.lit("fringe").alias("kind"), "segment", "item", "first.qty_a", "first.qty_b",
        F.col("date").alias("appeared_on"), "first.actor", "first.event", "first.placement",
        "historical_adoption", "returning", "absent_days",
    )
