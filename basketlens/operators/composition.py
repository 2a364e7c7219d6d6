"""Who registered what: listings, segment splits, conversion and share snapshots."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHALLENGE, LEAGUE, EngineConfig
from ..functions.frames import stacked
from ..functions.shares import cap_effect, epoch_label, finish_label, share
from .scope import held


def newest_first(frame: DataFrame) -> DataFrame:
    """Newest day first, then best finish with unranked lists last, then actor."""
    return frame.orderBy(F.desc("date"), F.asc_nulls_last("placement"), "actor", "list_id")


def cohort_lists(baskets: DataFrame, day: str | None = None, segment: str | None = None) -> DataFrame:
    found = baskets.where("member")
    if day:
        found = found.where(F.col("date") == F.lit(day).cast("date"))
    if segment:
        found = found.where(F.col("segment") == segment)
    return newest_first(
        found.select(
            "list_id", "actor", "event", "event_id", "event_class", "date", "placement",
            "points", "record", "segment", finish_label().alias("finish"),
        )
    )


def item_configurations(items: DataFrame, item: str | None = None, day: str | None = None) -> DataFrame:
    """The configuration of an item, or of every item, in each cohort list."""
    found = items.where("member")
    if item:
        found = found.where(F.col("item") == item)
    if day:
        found = found.where(F.col("date") == F.lit(day).cast("date"))
    return found.select(
        "list_id", "actor", "event_id", "date", "segment", "item", "qty_a", "qty_b",
        (F.col("qty_a") + F.col("qty_b")).alias("total"),
    )


def item_pool(items: DataFrame) -> DataFrame:
    """Every item the cohort ever registered, over the whole history."""
    return items.where("member").select("item").distinct()


def kept_signature(items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Signature items each near-miss list holds: at most the rule's own length."""
    return (
        items.where(F.col("near_miss") & F.col("item").isin(*cfg.signature) & (held(cfg) > 0))
        .groupBy("list_id")
        .agg(F.collect_set("item").alias("kept"))
    )


def near_misses(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, day: str | None = None) -> DataFrame:
    """Lists holding the watch item that miss the rule, and what each one dropped."""
    watched = baskets.where("near_miss")
    if day:
        watched = watched.where(F.col("date") == F.lit(day).cast("date"))
    rule = F.array(*[F.lit(item) for item in cfg.signature])
    listed = watched.join(kept_signature(items, cfg), "list_id").select(
        "list_id", "actor", "event", "event_id", "event_class", "date", "placement", "points",
        "record", finish_label().alias("finish"),
        F.filter(rule, lambda item: F.array_contains("kept", item)).alias("kept"),
        F.filter(rule, lambda item: ~F.array_contains("kept", item)).alias("dropped"),
    )
    return newest_first(listed)


def segment_ratio(baskets: DataFrame) -> DataFrame:
    """How the cohort splits over segments, per day and stratum, hybrids included."""
    day = Window.partitionBy("date", "stratum")
    return (
        baskets.where("member")
        .groupBy("date", "stratum", "segment")
        .agg(F.count("*").alias("lists"))
        .withColumn("share", share(F.col("lists"), F.sum("lists").over(day)))
    )


def conversion_gap(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A segment's share of league actors less its share of challenge actors,
    either side of the epoch start, counting each actor once and every list."""
    counted = (
        baskets.where("member")
        .groupBy(epoch_label("date", cfg).alias("regime"), "stratum", "segment")
        .agg(F.countDistinct("actor").alias("actors"), F.count("*").alias("lists"))
    )
    sides = {"league": LEAGUE, "challenge": CHALLENGE}
    wide = counted.groupBy("regime", "segment").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("stratum") == name, F.col(unit))), F.lit(0)).alias(f"{side}_{unit}")
            for side, name in sides.items()
            for unit in ("actors", "lists")
        ]
    )
    regime = Window.partitionBy("regime")
    shares = {
        (side, unit): share(F.col(f"{side}_{unit}"), F.sum(f"{side}_{unit}").over(regime))
        for side in sides
        for unit in ("actors", "lists")
    }
    read = wide.select(
        "regime", "segment", "league_actors", "challenge_actors",
        shares["league", "actors"].alias("league_share"),
        shares["challenge", "actors"].alias("challenge_share"),
        (shares["league", "actors"] - shares["challenge", "actors"]).alias("gap"),
        (shares["league", "lists"] - shares["challenge", "lists"]).alias("uncapped"),
    )
    return read.withColumn("cap_effect", cap_effect("gap", "uncapped", cfg))


def share_trend(snapshots: DataFrame, cohort: str, window_days: int) -> DataFrame:
    """One cohort's share in readings of one length, oldest first."""
    return (
        snapshots.where((F.col("cohort") == cohort) & (F.col("window_days") == window_days))
        .select("captured_on", "window_days", "share", "deck_count")
        .orderBy("captured_on")
    )


def share_as_of(days: DataFrame, snapshots: DataFrame, cohort: str, window_days: int) -> DataFrame:
    """For every day, the last reading taken on or before it; NULL before the first.

    Days and readings are stacked and the last reading carried forward. Both
    sides are one row per calendar day, which bounds the single ordered pass.
    """
    readings = share_trend(snapshots, cohort, window_days).select(
        F.col("captured_on").alias("day"),
        F.struct("captured_on", "window_days", "share", "deck_count").alias("reading"),
        F.lit(False).alias("asked"),
    )
    asked = days.select(F.col("day")).distinct().withColumn("asked", F.lit(True))
    carried = Window.partitionBy(F.lit(cohort)).orderBy("day", "asked")
    return (
        stacked(readings, asked)
        .withColumn("stood", F.last("reading", ignorenulls=True).over(carried))
        .where("asked")
        .select("day", "stood.captured_on", "stood.window_days", "stood.share", "stood.deck_count")
    )


def series(items: DataFrame, baskets: DataFrame, start: str, near_miss: bool = False) -> DataFrame:
    """Lists from a day on, each carrying the configurations it registered.

    Only where a reader needs a list whole; the readings here stay in long form.
    A near-miss series is in no segment and says it is not the cohort's.
    """
    chosen = F.col("near_miss") if near_miss else F.col("member")
    held_items = (
        items.where(chosen & (F.col("date") >= F.lit(start).cast("date")))
        .groupBy("list_id")
        .agg(F.array_sort(F.collect_list(F.struct("item", "qty_a", "qty_b"))).alias("configurations"))
    )
    listed = baskets.where(chosen & (F.col("date") >= F.lit(start).cast("date"))).select(
        "list_id", "actor", "event", "segment", "member", "stratum", "date", "placement", "weight"
    )
    return listed.join(held_items, "list_id", "left")
