"""Weekly average copies per panel, board and item over challenge lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, EngineConfig
from ..functions.dates import last_complete_sunday, week_end
from ..functions.shares import share
from .scope import last_day, since

BOARDS = (("mainboard", "a"), ("sideboard", "b"))


def panel_of(split: Column, other: Column, cfg: EngineConfig) -> Column:
    """Which of the two builds a list is, on board-a copies, or neither."""
    one = (split <= cfg.panel_split_max) & other.between(*cfg.panel_other_range)
    return F.when(one, F.lit(cfg.panel_names[0])).when(
        split.between(*cfg.panel_split_range), F.lit(cfg.panel_names[1])
    )


def panels(items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The panel of every list holding one of the two deciding items."""
    copies = lambda name: F.coalesce(
        F.sum(F.when(F.col("item") == name, F.col("qty_a"))), F.lit(0)
    )
    return (
        items.where(F.col("item").isin(cfg.panel_split_item, cfg.panel_other_item))
        .groupBy("list_id")
        .agg(copies(cfg.panel_split_item).alias("split"), copies(cfg.panel_other_item).alias("other"))
        .select("list_id", panel_of(F.col("split"), F.col("other"), cfg).alias("panel"))
    )


def challenge_lists(frame: DataFrame, cfg: EngineConfig, start: str | None = None) -> DataFrame:
    return since(frame, start or cfg.epoch_start).where(F.col("member") & (F.col("stratum") == CHALLENGE))


def binned_lists(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, start: str | None = None) -> DataFrame:
    """Every challenge list with its panel, its week, and why it is left out if it is.

    A week counts once its own Sunday has been reached.
    """
    lists = challenge_lists(baskets, cfg, start)
    settled = last_complete_sunday(last_day(lists))
    week = week_end(F.col("date"))
    named = panels(challenge_lists(items, cfg, start), cfg)
    # A list holding neither item still has counts: none of both.
    absent = panel_of(F.lit(0), F.lit(0), cfg)
    return (
        lists.select("list_id", week.alias("week"))
        .join(named.withColumn("named", F.lit(True)), "list_id", "left")
        .withColumn("panel", F.when(F.col("named"), F.col("panel")).otherwise(absent))
        .withColumn(
            "dropped",
            F.when(F.col("week") > settled, F.lit("incomplete final week")).when(
                F.col("panel").isNull(), F.lit("neither build")
            ),
        )
        .drop("named")
    )


def dropped_lists(binned: DataFrame) -> DataFrame:
    return binned.where("dropped IS NOT NULL").groupBy("dropped").agg(F.count("*").alias("lists"))


def panel_weeks(binned: DataFrame) -> DataFrame:
    return binned.where("dropped IS NULL").groupBy("panel", "week").agg(F.count("*").alias("lists"))


def weekly_averages(items: DataFrame, binned: DataFrame, typed: DataFrame, cfg: EngineConfig, start: str | None = None) -> DataFrame:
    """Average copies over every list of the panel-week, typed items left out."""
    kept = binned.where("dropped IS NULL").select("list_id", "panel", "week")
    # A row per panel and week, bounded by the calendar; typed items are a part of the vocabulary.
    copies = (
        challenge_lists(items, cfg, start).select("list_id", "item", "qty_a", "qty_b")
        .join(kept, "list_id")
        .groupBy("panel", "week", "item")
        .agg(F.sum("qty_a").alias("a"), F.sum("qty_b").alias("b"))
        .join(typed, "item", "left_anti")
        .join(F.broadcast(panel_weeks(binned)), ["panel", "week"])
    )
    boards = F.array(*[F.struct(F.lit(name).alias("board"), F.col(c).alias("copies")) for name, c in BOARDS])
    return copies.select("panel", "week", "item", "lists", F.inline(boards)).select(
        "week", "panel", "board", "item", share(F.col("copies"), F.col("lists")).alias("avg_copies"), "lists"
    )


def movers(averages: DataFrame, weeks: DataFrame, cfg: EngineConfig, threshold: float | None = None) -> DataFrame:
    """Items whose average swung far enough on any panel and board, widest first.

    A week an item is absent from counts as zero, so where it has fewer points
    than there are weeks zero is among its values; nothing has to be filled in.
    """
    bar = cfg.mover_threshold if threshold is None else threshold
    every = weeks.agg(F.countDistinct("week")).scalar()
    high, low = F.max("avg_copies"), F.min("avg_copies")
    gaps = F.count("*") < F.max("weeks")
    swings = (
        averages.withColumn("weeks", every)
        .groupBy("panel", "board", "item")
        .agg(
            (F.when(gaps, F.greatest(high, F.lit(0.0))).otherwise(high)
             - F.when(gaps, F.least(low, F.lit(0.0))).otherwise(low)).alias("swing")
        )
    )
    return (
        swings.groupBy("item").agg(F.max("swing").alias("swing")).where(F.col("swing") >= bar)
        .orderBy(F.desc("swing"), "item")
    )


def densify(averages: DataFrame, weeks: DataFrame, kept: DataFrame) -> DataFrame:
    """Every item on every board in every panel-week that has lists, absent as zero.

    The panel-weeks, a few a calendar week, are carried as one array and laid
    out per item, so the dense table is generated and not joined.
    """
    calendar = weeks.agg(F.collect_list(F.struct("panel", "week", "lists"))).scalar()
    boards = F.array(*[F.lit(name) for name, _ in BOARDS])
    dense = (
        averages.select("item").distinct()
        .select("item", F.explode(boards).alias("board"))
        .select("item", "board", F.inline(calendar))
    )
    shown = kept.select("item", F.lit(True).alias("kept"))
    return (
        dense.join(averages.drop("lists"), ["panel", "week", "board", "item"], "left")
        .join(shown, "item", "left")
        .select(
            "week", "panel", "board", "item",
            F.coalesce("avg_copies", F.lit(0.0)).alias("avg_copies"), "lists",
            F.coalesce("kept", F.lit(False)).alias("highlight"),
        )
    )


def write_table(dense: DataFrame, path: str) -> None:
    dense.select("week", "panel", "board", "item", "avg_copies", "lists", "highlight").write.option(
        "header", True
    ).csv(path)
