"""The flag ledger: what has been raised, and when it was first said.

Every kind of flag lies in one wide table. Detection is a reading of the store;
the ledger is the memory, so a flag keeps the day it was first seen and is kept
after the store stops raising it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.dates import first_weekend_after
from ..functions.frames import stacked
from ..session import fresh_path, written
from .scope import day_number

SLOT = "struct<item:string,qty_a:int,qty_b:int>"
DISSENTER = "struct<actor:string,finishes:bigint>"

LEDGER_SCHEMA = (
    "kind string, segment string, item string, qty_a int, qty_b int, raised_on date, "
    "from_adoption double, to_adoption double, population bigint, origin_actor string, "
    "origin_event string, origin_date date, origin_placement int, tilt double, "
    "challenge_before double, state string, league_after double, challenge_after double, "
    "tilt_after double, resolved_on date, now_adoption double, standing string, "
    "appeared_on date, actor string, event string, placement int, historical_adoption double, "
    "returning boolean, absent_days int, appearances bigint, actors array<string>, "
    f"dissenters array<{DISSENTER}>, hypothesis_candidate boolean, stratum string, "
    f"list_id bigint, date date, mode string, delta int, novel array<{SLOT}>, missing array<string>, "
    "followers bigint, adopted_item string, needed int, first_seen date"
)


def identity() -> Column:
    """What makes two readings the same flag: an episode, a card in a segment, a
    standing preference, or a list an actor published."""
    text = lambda *names: F.to_json(F.struct(F.col("kind"), *[F.col(n) for n in names]))
    return (
        F.when(F.col("kind") == "hype", text("segment", "item", "qty_a", "qty_b", "raised_on"))
        .when(F.col("kind") == "pet-tech", text("segment", "item", "qty_a", "qty_b"))
        .when(F.col("kind") == "breakthrough", text("actor", "event", "date"))
        .otherwise(text("segment", "item"))
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def unified(flags: list[DataFrame]) -> DataFrame:
    """Every kind of flag in the one ledger shape."""
    shape = empty(flags[0].sparkSession)
    return stacked(shape, *flags).select(*shape.columns)


def detect(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every flag the store raises right now."""
    from .actors import pet_items
    from .departures import breakthroughs
    from .hype import hype
    from .novelty import fringe_flags

    return unified(
        [
            hype(items, baskets, cfg),
            fringe_flags(items, baskets, cfg),
            pet_items(items, baskets, cfg),
            breakthroughs(items, baskets, cfg),
        ]
    )


def merge(standing: DataFrame, detected: DataFrame, today) -> DataFrame:
    """Detections over the standing ledger, by identity.

    A flag's readings are this run's where it was detected and the ledger's where
    it was not; its first day is the ledger's where it has one. Both sides stack
    and meet in one aggregation keyed by the whole identity. Two lists of one
    actor in one event are one flag, the smaller list id standing for it.
    """
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    columns = [c for c in detected.columns if c != "first_seen"]
    old = standing.select(*columns, "first_seen", F.lit(0).alias("run"))
    new = detected.select(*columns, F.lit(None).cast("date").alias("first_seen"), F.lit(1).alias("run"))
    latest = F.struct("run", (-F.coalesce("list_id", F.lit(0))).alias("smaller"))
    return (
        stacked(old, new)
        .groupBy(identity().alias("flag_id"))
        .agg(
            F.max_by(F.struct(*columns), latest).alias("flag"),
            F.coalesce(F.min("first_seen"), today).alias("first_seen"),
        )
        .select("flag.*", "first_seen")
    )


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger as it stands, or an empty one where no run has written any."""
    if path is None:
        return empty(spark)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def record(standing: DataFrame, detected: DataFrame, today) -> tuple[DataFrame, str]:
    """Merge and write a new ledger version beside the old one; the caller keeps
    the path of the version that stands."""
    merged = merge(standing, detected, today)
    path = fresh_path(merged.sparkSession, "ledger")
    return written(merged, path), path


def lineage(ledger: DataFrame, segment: str | None = None) -> DataFrame:
    """Departures traced to the first episode any of their items led to.

    Departures ask by segment, item and day, and the next episode is carried back
    over days, so departures and episodes are never paired; most meet none and
    are rows all the same. Departures grow with the history and few columns of them
    look small, so they meet in sorted joins.
    """
    flags = ledger.where(F.col("kind") == "breakthrough")
    if segment:
        flags = flags.where(F.col("segment") == segment)
    told = F.struct("first_seen", "qty_a", "qty_b", "state", "standing")
    episodes = (
        ledger.where(F.col("kind") == "hype")
        .groupBy("segment", "item", "raised_on")
        .agg(F.min(told).alias("told"))
        .select("segment", "item", F.col("raised_on").alias("spiked_on"), "told")
    )
    opened = flags.select(
        "segment", "actor", "event", "date", F.explode("novel").alias("slot")
    ).withColumn("item", F.col("slot.item"))
    asked = ["segment", "item", "date"]
    ahead = Window.partitionBy("segment", "item").orderBy(day_number()).rangeBetween(0, Window.unboundedFollowing)
    coming = (
        stacked(
            opened.select(*asked).distinct().withColumn("asked", F.lit(True)),
            episodes.select("segment", "item", F.col("spiked_on").alias("date"), F.struct("spiked_on", "told").alias("next")),
        )
        .withColumn("next", F.min("next").over(ahead))
        .where("asked AND next IS NOT NULL")
        .select(*asked, "next.*")
    )
    first = (
        opened.join(coming.hint("merge"), asked)
        .groupBy("actor", "event", "date")
        .agg(F.min(F.struct("spiked_on", "item", "told")).alias("spread"))
    )
    return (
        flags.join(first.hint("merge"), ["actor", "event", "date"], "left")
        .select(
            "segment", "stratum", "actor", "event", "date", "placement", "mode", "delta", "novel",
            "missing", F.col("state").alias("followed"), "followers", "needed", "adopted_item",
            F.col("spread.item").alias("spread_item"), F.col("spread.spiked_on").alias("spiked_on"),
            F.col("spread.told.state").alias("resolved"), F.col("spread.told.standing").alias("standing"),
        )
        .orderBy(F.desc("date"), "actor", "event")
    )


def clocks(ledger: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The day each open flag could be answered, and whether the deadline comes first."""
    weekend = first_weekend_after(F.col("raised_on"))
    inside = weekend <= F.date_add("raised_on", cfg.hype_window_days)
    hype = (F.col("kind") == "hype") & (F.col("state") == "raised")
    watched = (F.col("kind") == "breakthrough") & (F.col("state") == "watching")
    answerable = F.when(hype & inside, weekend).when(watched, F.date_add("date", cfg.trendsetter_days))
    waiting = (F.col("kind") == "hype") & (F.col("state") == "matured")
    return (
        ledger.where(F.col("kind").isin("hype", "breakthrough"))
        .withColumn("answerable_on", answerable)
        .select(
            "kind", "segment", "item", "qty_a", "qty_b", "raised_on", "actor", "event", "date", "state",
            "answerable_on",
            (F.col("answerable_on") > F.lit(cfg.deadline).cast("date")).alias("past_deadline"),
            waiting.alias("waiting_on_evidence"),
        )
    )
