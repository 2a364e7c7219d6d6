"""Departures: finished lists built outside their segment, and what followed.

A list is read against what its segment had registered on earlier days. That
tally lives at the grain of segment, stratum, item and day; only its outlying
rows, items under the minority bar and items over the core bar, are joined to
the lists.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.frames import stacked
from ..functions.shares import finished, share
from ..session import settled
from .actors import debuts, first_registrations
from .novelty import before_day, history, novelty
from .scope import day_number


PLACE = ("against", "stratum")


def read_against(frame: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows beside the segments they answer to: their own, or every named one
    for a hybrid or a near miss. The named segments are configuration."""
    named = F.array(*[F.lit(name) for name in cfg.segment_names])
    own = F.array(F.col("segment"))
    answers = F.when(F.col("segment").isin(*cfg.segment_names), own).otherwise(named)
    return frame.withColumn("against", F.explode(answers)).withColumn(
        "own", F.coalesce(F.col("segment") == F.col("against"), F.lit(False))
    )


def segment_sizes(lists: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Lists each segment had published before, and by the end of, every day."""
    daily = lists.groupBy(*PLACE, "date").agg(F.count_if("own").alias("lists"))
    before = F.coalesce(F.sum("lists").over(before_day(*PLACE)), F.lit(0))
    return daily.withColumn("size_before", before).withColumn("size_after", F.col("size_before") + F.col("lists"))


def item_tally(items: DataFrame) -> DataFrame:
    """Plays of every item before each day any list was read against it."""
    daily = items.groupBy(*PLACE, "item", "date").agg(F.count_if("own").alias("plays"))
    before = F.coalesce(F.sum("plays").over(before_day(*PLACE, "item")), F.lit(0))
    return daily.withColumn("plays_before", before)


def core_days(tally: DataFrame, sizes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Items near-unanimous in a segment as of each day it was read against.

    A share only rises on a day the item is played, so an item never over the
    bar at the end of such a day never is. The few that were are laid over the
    segment's days; the rest are not.
    """
    rose = (
        tally.join(F.broadcast(sizes), [*PLACE, "date"])
        .where(share(F.col("plays_before") + F.col("plays"), F.col("size_after")) >= cfg.core_adoption)
        .select(*PLACE, "item")
        .distinct()
    )
    played = tally.where("plays > 0").select(*PLACE, "item", "date", "plays")
    laid = (
        rose.join(F.broadcast(sizes.select(*PLACE, "date", "size_before")), list(PLACE))
        .join(played, [*PLACE, "item", "date"], "left")
        .withColumn("plays_before", F.coalesce(F.sum("plays").over(before_day(*PLACE, "item")), F.lit(0)))
    )
    return laid.where(
        (F.col("size_before") >= cfg.departure_min_lists)
        & (share(F.col("plays_before"), F.col("size_before")) >= cfg.core_adoption)
    ).select(*PLACE, "item", "date")


def novel_days(tally: DataFrame, sizes: DataFrame, fringe: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Items hardly any of a segment had played as of each day, and whether one
    was both unseen by the segment and fringe to the whole history."""
    established = sizes.where(F.col("size_before") >= cfg.departure_min_lists)
    rare = (
        tally.join(F.broadcast(established.select(*PLACE, "date", "size_before")), [*PLACE, "date"])
        .where(share(F.col("plays_before"), F.col("size_before")) < cfg.supported_minority)
        .select(*PLACE, "item", "date", (F.col("plays_before") == 0).alias("unseen"))
    )
    flagged = fringe.where("fringe").select("item", "date", F.lit(True).alias("fringe"))
    return rare.join(flagged, ["item", "date"], "left").withColumn(
        "introduced", F.col("unseen") & F.coalesce("fringe", F.lit(False))
    ).drop("unseen", "fringe")


def candidates(
    items: DataFrame, baskets: DataFrame, cfg: EngineConfig, read_novelty: DataFrame | None = None
) -> DataFrame:
    """Every finished list with the segment it departs least from, what it holds
    that segment hardly plays and what it lacks that segment is agreed on.

    All of it looks back from the list's day: a shorter history has the same
    candidates up to its last day.
    """
    seen = novelty(items, baskets, cfg) if read_novelty is None else read_novelty
    facts = read_against(history(items, cfg.epoch_start), cfg)
    lists = read_against(history(baskets, cfg.epoch_start), cfg)
    # Both are at day grain and read several times over: written once.
    sizes = settled(segment_sizes(lists, cfg), "segment-sizes")
    tally = settled(item_tally(facts), "item-tally")
    core = core_days(tally, sizes, cfg)
    novel = novel_days(tally, sizes, seen, cfg)
    outlying = stacked(
        novel.withColumn("is_core", F.lit(False)),
        core.withColumn("introduced", F.lit(False)).withColumn("is_core", F.lit(True)),
    )
    held = F.struct("item", "qty_a", "qty_b")
    touched = (
        facts.where(finished(cfg))
        .join(outlying, [*PLACE, "item", "date"])
        .groupBy("list_id", "against")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("is_core"), held))).alias("novel"),
            F.collect_list(F.when(F.col("is_core"), F.col("item"))).alias("held_core"),
            F.bool_or("introduced").alias("introduced"),
        )
    )
    agreed = core.groupBy(*PLACE, "date").agg(F.array_sort(F.collect_list("item")).alias("agreed"))
    established = sizes.where(F.col("size_before") >= cfg.departure_min_lists).select(*PLACE, "date")
    read = (
        lists.where(finished(cfg))
        .join(F.broadcast(established), [*PLACE, "date"])
        .join(touched, ["list_id", "against"], "left")
        .join(agreed, [*PLACE, "date"], "left")
    )
    nothing = F.array().cast("array<string>")
    lacks = F.array_except(F.coalesce("agreed", nothing), F.coalesce("held_core", nothing))
    no_novel = F.array().cast("array<struct<item:string,qty_a:int,qty_b:int>>")
    told = (
        read.withColumn("novel", F.coalesce("novel", no_novel))
        .withColumn("missing", lacks)
        .withColumn("introduced", F.coalesce("introduced", F.lit(False)))
        .withColumn("delta", F.size("novel") + F.size("missing"))
    )
    carried = F.struct(
        "against", "own", "stratum", "actor", "event", "date", "placement", "delta", "novel",
        "missing", "introduced",
    )
    nearest = told.groupBy("list_id").agg(F.min_by(carried, F.struct("delta", "against")).alias("at"))
    return nearest.select("list_id", "at.*")


def departed(read: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Candidates that depart far enough, by a new item or by enough known ones."""
    mode = F.when(F.col("introduced"), F.lit("fringe")).when(
        F.col("delta") >= cfg.departure_delta, F.lit("in-pool")
    )
    return (
        read.where(F.col("own") | (F.col("delta") <= cfg.departure_ceiling))
        .withColumn("mode", mode)
        .where(F.col("mode").isNotNull())
        .select(
            F.lit("breakthrough").alias("kind"), F.col("against").alias("segment"), "stratum",
            "list_id", "actor", "event", "date", "placement", "mode", "delta", "novel", "missing",
        )
    )


def departures(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    return departed(candidates(items, baskets, cfg), cfg)


def standing_intervals(intervals: DataFrame, probes: DataFrame, *keys: str) -> DataFrame:
    """How many intervals [opens, closes) of its key each probe day lies in.

    Counted by openings less closings up to the day, so neither intervals nor
    probes are ever paired and a key's rows shrink to one a day.
    """
    steps = intervals.where("opens < closes").select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("opens").alias("date"), F.lit(1).alias("step")),
                F.struct(F.col("closes").alias("date"), F.lit(-1).alias("step")),
            )
        ),
    )
    asked = probes.select(*keys, "date").distinct().withColumn("asked", F.lit(True))
    daily = (
        stacked(steps, asked)
        .groupBy(*keys, "date")
        .agg(F.coalesce(F.sum("step"), F.lit(0)).alias("step"), F.max("asked").alias("asked"))
    )
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("standing", F.sum("step").over(running)).where("asked").drop("step", "asked")


def follower_bar(baskets: DataFrame, days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Followers a departure on each day has to draw: a share of the actors who
    published in the window after it, and never fewer than the floor."""
    active = history(baskets, cfg.history_start).select("actor", "date").distinct()
    earlier = F.lag("date").over(Window.partitionBy("actor").orderBy("date"))
    reach = F.date_sub("date", cfg.trendsetter_days)
    spans = active.withColumn("earlier", earlier).select(
        F.greatest(reach, F.coalesce("earlier", reach)).alias("opens"), F.col("date").alias("closes")
    )
    bar = F.bround(F.col("standing") * F.lit(cfg.trendsetter_share), 0).cast("int")
    return standing_intervals(spans, days).select(
        "date",
        F.col("standing").alias("field"),
        F.greatest(F.lit(cfg.trendsetter_followers), bar).alias("needed"),
    )


def adoptions(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """First registration of each item by each actor, with the actor's debut.

    Actors grow with the history, so their debuts are never sent whole to every task.
    """
    firsts = first_registrations(history(items, cfg.history_start))
    return firsts.join(debuts(history(baskets, cfg.history_start)).hint("merge"), "actor")


def item_followers(items: DataFrame, baskets: DataFrame, probes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Followers of an item after each probed day: actors it was new to and the
    history was not. An actor follows every day from the later of its debut and
    the window's reach, up to the day before it took the item up."""
    wanted = probes.select("item").distinct()
    taken = adoptions(items, baskets, cfg).join(wanted, "item", "left_semi")
    spans = taken.select(
        "item",
        F.greatest(F.col("debut"), F.date_sub("first", cfg.trendsetter_days)).alias("opens"),
        F.col("first").alias("closes"),
    )
    return standing_intervals(spans, probes, "item").withColumnRenamed("standing", "followers")


def breakthroughs(
    items: DataFrame, baskets: DataFrame, cfg: EngineConfig, found: DataFrame | None = None
) -> DataFrame:
    """Departures with their follow-through: the item that caught on most, how
    many followed, how many it took, and what that makes the departure.

    Departures and their items grow with the history, so they meet in sorted joins.
    """
    flags = settled(departures(items, baskets, cfg), "departures") if found is None else found
    opened = flags.select("list_id", "date", F.explode("novel").alias("slot")).select(
        "list_id", "date", "slot.item"
    )
    followers = item_followers(items, baskets, opened, cfg)
    caught = (
        opened.join(followers.hint("merge"), ["item", "date"])
        .groupBy("list_id")
        .agg(F.min(F.struct((-F.col("followers")).alias("behind"), "item")).alias("most"))
        .select("list_id", (-F.col("most.behind")).alias("followers"), F.col("most.item").alias("adopted_item"))
    )
    # One row per flagged day: the calendar bounds the broadcast.
    bar = follower_bar(baskets, flags, cfg).select("date", "needed")
    last = history(baskets, cfg.history_start).agg(F.max("date")).scalar()
    drawn = F.coalesce("followers", F.lit(0))
    state = (
        F.when(drawn >= F.col("needed"), F.lit("trendsetter"))
        .when(F.date_add("date", cfg.trendsetter_days) > last, F.lit("watching"))
        .otherwise(F.lit("breakthrough"))
    )
    return (
        flags.join(caught.hint("merge"), "list_id", "left")
        .join(F.broadcast(bar), "date")
        .select(*flags.columns, state.alias("state"), drawn.alias("followers"), "adopted_item", "needed")
    )


def follower_names(items: DataFrame, baskets: DataFrame, flags: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Who followed an adopted item after each day a departure led with it.

    Keyed by item and day, since followers depend on nothing else: departures of
    one day share their rows and look them up. An adoption follows the days of the
    window before it, so its rows are bounded by the calendar. Days are cut into
    blocks as long as the window, so an adoption meets only the days of its own
    block and the one before.
    """
    span = cfg.trendsetter_days
    block = lambda day: F.floor(day / span)
    led = (
        flags.where("followers > 0")
        .select("date", F.col("adopted_item").alias("item"))
        .distinct()
        .withColumn("number", day_number())
        .withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("number") + 1), block(F.col("number") + span)))))
    )
    taken = adoptions(items, baskets, cfg).withColumn("block", block(day_number("first")))
    return (
        led.join(taken, ["item", "block"])
        .where(
            (F.col("first") > F.col("date"))
            & (F.col("first") <= F.date_add("date", span))
            & (F.col("debut") <= F.col("date"))
        )
        .select("date", "item", F.col("actor").alias("follower"), F.col("first").alias("taken_up"))
    )
