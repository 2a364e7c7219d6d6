"""Rules and scopes every reading shares: cohort, segment, stratum, weight, windows.

`enrich` is where the fact rows take on what their list is, once, so no later
reading joins the two tables again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shares import segment_of, share, stratum

LIST_COLUMNS = (
    "list_id", "actor", "event", "event_id", "stratum", "date", "placement",
    "weight", "member", "near_miss", "segment",
)


def held(cfg: EngineConfig) -> Column:
    """Copies that decide membership, on the board the rule reads."""
    if cfg.membership_board == "either":
        return F.col("qty_a") + F.col("qty_b")
    return F.col("qty_a")


def marks(items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per list: signature items held, copies of the divergence item, watch item,
    and the typed total.

    Lists holding nothing that counts have no row. The filter runs before the
    shuffle, so only rows of named or typed items move.
    """
    return items.where(_counts_for(cfg)).groupBy("list_id").agg(*marked(cfg))


def _counts_for(cfg: EngineConfig) -> Column:
    named = sorted({*cfg.signature, cfg.watch_item, cfg.divergence_item})
    return F.col("item").isin(*named) | (F.col("typed_a") > 0)


def marked(cfg: EngineConfig) -> list[Column]:
    """The marks of a list as aggregates over its items; other items change none of them."""
    copies = held(cfg)
    has = copies > 0
    counted = F.coalesce(_counts_for(cfg), F.lit(False))
    return [
        F.when(F.bool_or(counted), F.count_if(has & F.col("item").isin(*cfg.signature))).alias("signature_held"),
        F.sum(F.when(F.col("item") == cfg.divergence_item, copies)).alias("divergence_copies"),
        F.coalesce(F.bool_or(has & (F.col("item") == cfg.watch_item)), F.lit(False)).alias("watched"),
        F.sum("typed_a").cast("int").alias("typed_total"),
    ]


def finish_weights(baskets: DataFrame) -> DataFrame:
    """Each list with its points over the best total of its whole event.

    The best is an aggregate joined back and not a window: an event may hold a
    third of all lists and a window would sort it in one task.
    """
    best = baskets.where(F.col("points").isNotNull()).groupBy("event_id").agg(F.max("points").alias("best"))
    return (
        baskets.join(best, "event_id", "left")
        .withColumn("weight", share(F.col("points"), F.col("best")))
        .drop("best")
    )


def classify(baskets: DataFrame, items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Baskets with cohort, segment, stratum, near-miss and finish weight."""
    return labelled(finish_weights(baskets), items, cfg)


def labelled(baskets: DataFrame, items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Baskets with all that follows from a list by itself: everything but its weight."""
    return by_marks(baskets.join(marks(items, cfg), "list_id", "left"), cfg)


def by_marks(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Baskets beside their marks, with what follows from those."""
    member = F.coalesce(F.col("signature_held") == len(cfg.signature), F.lit(False))
    return (
        baskets.withColumn("member", member)
        .withColumn("typed_total", F.coalesce("typed_total", F.lit(0)))
        .withColumn("near_miss", ~F.col("member") & F.coalesce("watched", F.lit(False)))
        .withColumn("cohort", F.when(F.col("member"), F.lit(cfg.cohort)))
        .withColumn("segment", F.when(F.col("member"), segment_of(F.col("divergence_copies"), cfg)))
        .withColumn("stratum", stratum("event_class"))
        .drop("signature_held", "divergence_copies", "watched")
    )


def attach(items: DataFrame, baskets: DataFrame) -> DataFrame:
    """Every item row carrying its list's columns.

    Lists grow with the history, and a few columns of compressed files look small
    enough to be sent to every task, so the join is a sorted one at any size.
    """
    return items.join(baskets.select(*LIST_COLUMNS).hint("merge"), "list_id")


def windows(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The fresh and baseline windows, anchored on the last published day.

    One row; every bound is NULL where nothing was published.
    """
    epoch = F.lit(cfg.epoch_start).cast("date")
    cut = F.date_sub("as_of", cfg.fresh_days)
    reach = F.greatest(epoch, F.date_sub("as_of", cfg.fresh_days + cfg.baseline_days - 1))
    return baskets.agg(F.max("date").alias("as_of")).select(
        "as_of",
        F.date_add(cut, 1).alias("fresh_start"),
        F.col("as_of").alias("fresh_end"),
        F.when(F.col("as_of").isNotNull(), reach).alias("baseline_start"),
        cut.alias("baseline_end"),
    )


def in_windows(frame: DataFrame, read: DataFrame) -> DataFrame:
    """Cohort rows inside the two windows, labelled by which one.

    The bounds are scalar subqueries, so they reach the scan as plain date
    filters and nothing is joined.
    """
    bound = {name: read.select(name).scalar() for name in ("baseline_start", "baseline_end", "as_of")}
    day = F.col("date")
    return frame.where(
        F.col("member") & (day >= bound["baseline_start"]) & (day <= bound["as_of"])
    ).withColumn("fresh", day > bound["baseline_end"])


def since(frame: DataFrame, start: str) -> DataFrame:
    return frame.where(F.col("date") >= F.lit(start).cast("date"))


def day_number(day="date") -> Column:
    """Days since the first of 1970, so that frames can range over days."""
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def last_day(frame: DataFrame) -> Column:
    """The last day a frame holds, as a scalar subquery."""
    return frame.agg(F.max("date")).scalar()
