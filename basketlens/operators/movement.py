"""Where a configuration is going: board migration, substitution, climbing items."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shares import direction, share
from ..session import settled
from .adoption import PLACE, WINDOWS
from .scope import in_windows, windows

SPLIT = ("target", "target_a", "target_b")


def migration(read: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Copies of every item by board in both windows, and how far they crossed."""
    sums = []
    for w in WINDOWS:
        lists = F.col(f"{w}_lists")
        sums += [
            F.sum(lists).alias(f"{w}_lists"),
            F.max(f"{w}_population").alias(f"{w}_population"),
            F.sum(F.col("qty_a") * lists).alias(f"{w}_main_copies"),
            F.sum(F.col("qty_b") * lists).alias(f"{w}_side_copies"),
        ]
    boards = read.groupBy(*PLACE, "item").agg(*sums)
    for w in WINDOWS:
        main, side = F.col(f"{w}_main_copies"), F.col(f"{w}_side_copies")
        boards = boards.withColumn(f"{w}_main_share", share(main, main + side))
    shifted = boards.withColumn("shift", F.col("fresh_main_share") - F.col("baseline_main_share"))
    return shifted.withColumn("direction", direction("shift", cfg))


def migrations(read: DataFrame, cfg: EngineConfig, floor: int | None = None) -> DataFrame:
    """Every item being moved between boards by enough lists, furthest first."""
    least = cfg.migration_min_lists if floor is None else floor
    return (
        migration(read, cfg)
        .where((F.col("direction") != "steady") & (F.least("fresh_lists", "baseline_lists") >= least))
        .orderBy(F.desc(F.abs("shift")), "item")
    )


def substitution(items: DataFrame, baskets: DataFrame, targets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What lists off a configuration registered instead, for every asked one.

    `targets(target, target_a, target_b)` splits each population's fresh lists in
    two. Only the holding half is joined to its items; the other half is the
    population's tally less that, so the larger half never moves.
    """
    halves, played, with_it = _halves(items, baskets, targets, cfg)
    read = halves.join(played, list(PLACE)).join(with_it, [*PLACE, *SPLIT, "item"], "left")
    return _traded(read)


def _halves(
    items: DataFrame, baskets: DataFrame, targets: DataFrame, cfg: EngineConfig
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of each target's two halves, lists an item, and of these the holding half's."""
    read = windows(baskets, cfg)
    fresh = in_windows(items, read).where("fresh").select(*PLACE, "list_id", "item", "qty_a", "qty_b")
    split = list(SPLIT)
    on_target = (
        (fresh.item == targets.target) & (fresh.qty_a == targets.target_a) & (fresh.qty_b == targets.target_b)
    )
    holders = fresh.join(targets, on_target).select("list_id", *PLACE, *split)
    with_it = (
        holders.select("list_id", *split)
        .join(fresh, "list_id")
        .groupBy(*PLACE, *split, "item")
        .agg(F.count("*").alias("on_lists"))
    )
    sizes = (
        in_windows(baskets, read).where("fresh").groupBy(*PLACE).agg(F.count("*").alias("population"))
    )
    halves = (
        holders.groupBy(*PLACE, *split)
        .agg(F.count("*").alias("on_it_lists"))
        .join(F.broadcast(sizes), list(PLACE))
        .withColumn("elsewhere_lists", F.col("population") - F.col("on_it_lists"))
        .where("elsewhere_lists > 0")
    )
    played = fresh.groupBy(*PLACE, "item").agg(F.count("*").alias("lists"))
    return halves, played, with_it


def _traded(read: DataFrame, *more: str) -> DataFrame:
    there = F.col("lists") - F.coalesce("on_lists", F.lit(0))
    return read.select(
        *PLACE, *SPLIT, "item",
        share(F.coalesce("on_lists", F.lit(0)), F.col("on_it_lists")).alias("on_it"),
        share(there, F.col("elsewhere_lists")).alias("elsewhere"),
        "on_it_lists", "elsewhere_lists", *more,
    ).withColumn("difference", F.col("elsewhere") - F.col("on_it"))


def substitution_ends(
    items: DataFrame, baskets: DataFrame, targets: DataFrame, cfg: EngineConfig, ends: int
) -> DataFrame:
    """The `ends` items most and least overrepresented off each target, as
    `series_ops.both_ends` of `substitution`, without making the table between.

    An item that no holder registered stands at its share elsewhere, so among a
    target's unseen items more lists stand higher, and equal lists go by name. Items
    are ranked so once a population; a target's own items are sparse in that ranking,
    and the first and last of the gaps between them are its unseen ends. Rows then grow
    with pairs seen together and 2 * `ends` a target, not with targets times items.
    Differences are compared at nine places, so a half is taken to have under 5e8 lists.
    """
    halves, played, with_it = _halves(items, baskets, targets, cfg)
    held, key = "items", [*PLACE, *SPLIT]
    place = Window.partitionBy(*PLACE)
    ranked = settled(
        played.withColumn("at", F.row_number().over(place.orderBy(F.desc("lists"), "item")))
        .withColumn(held, F.count("*").over(place)),
        "ranked-items",
    )
    halves = settled(halves, "halves")
    seen = settled(with_it.join(ranked, [*PLACE, "item"]).join(halves, key), "seen-pairs")
    # A row per segment and stratum: the configuration bounds the broadcast.
    sizes = F.broadcast(ranked.select(*PLACE, held).distinct())
    edges = halves.join(sizes, list(PLACE)).select(*key, held, F.explode(F.array(F.lit(0), (F.col(held) + 1).cast("int"))).alias("at"))
    walk = Window.partitionBy(*key)
    step = (
        seen.select(*key, held, "at").unionByName(edges)
        .withColumn("nth", F.row_number().over(walk.orderBy("at")))
        .withColumn("past", F.lag("at").over(walk.orderBy("at")))
        .withColumn("unseen", F.col(held) - F.count("*").over(walk) + 2)
        .withColumn("gap", F.col("at") - F.col("past") - 1)
        .where("gap > 0")
        .withColumn("above", F.col("past") - F.col("nth") + 2)
        .withColumn("below", F.col("unseen") - F.col("above") - F.col("gap"))
    )
    head = F.least(F.col("gap"), F.lit(ends) - F.col("above")).cast("int")
    tail = F.least(F.col("gap"), F.lit(ends) - F.col("below")).cast("int")
    none = F.array().cast("array<int>")
    first = F.when(head > 0, F.sequence(F.col("past") + 1, F.col("past") + head)).otherwise(none)
    last = F.when(tail > 0, F.sequence(F.col("at") - tail, F.col("at") - 1)).otherwise(none)
    unseen = (
        step.select(*key, F.explode(F.array_union(first, last)).alias("at"))
        .join(ranked, [*PLACE, "at"]).join(halves, key).withColumn("on_lists", F.lit(0).cast("long"))
    )
    # Rounded before ordering, so equal differences tie and the name decides.
    shown = F.round("difference", 9)
    traded = _traded(seen.unionByName(unseen), held)
    top = F.row_number().over(walk.orderBy(F.desc(shown), "item"))
    bottom = F.row_number().over(walk.orderBy(shown, F.desc("item")))
    return (
        traded.withColumn("top", top).withColumn("bottom", bottom)
        .where(F.least("top", "bottom") <= ends)
        .withColumn("from_top", F.when(F.col("top") <= ends, F.col("top")).otherwise(F.col(held) - F.col("bottom") + 1))
        .withColumn("from_bottom", F.col(held) - F.col("from_top") + 1)
        .withColumn("left_out", F.greatest(F.lit(0), F.col(held) - 2 * ends))
        .drop("top", "bottom", held)
    )


def pair_crosstab(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, support: float | None = None) -> DataFrame:
    """Pairs of items cross-tabulated over each population's fresh lists: which
    builds a population is divided into.

    Only items that `support` of the population's lists hold are paired; where a list
    holds n items on average these are at most n / support items a population. Pairs
    no list holds together have no row: each of them is opposed. A list's pairs are made in its own row, counted before they move, and the other
    three cells follow from the items' own counts. `diagonal` is the share of lists
    that hold both or neither, `opposed` of those that hold just one; a population
    divided on a pair has nearly all of its lists in one of the two.
    """
    support = cfg.pair_support if support is None else support
    read = windows(baskets, cfg)
    fresh = in_windows(items, read).where("fresh").select(*PLACE, "list_id", "item")
    sizes = in_windows(baskets, read).where("fresh").groupBy(*PLACE).agg(F.count("*").alias("population"))
    counted = fresh.groupBy(*PLACE, "item").agg(F.count("*").alias("lists"))
    # A row per segment and stratum: the configuration bounds the broadcast.
    often = counted.join(F.broadcast(sizes), list(PLACE)).where(F.col("lists") >= F.col("population") * support)
    often = settled(often, "frequent-items")
    held = (
        fresh.join(often.select(*PLACE, "item"), [*PLACE, "item"])
        .groupBy(*PLACE, "list_id")
        .agg(F.array_sort(F.collect_list("item")).alias("held"))
        .where(F.size("held") > 1)
    )
    after = lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("item"), y.alias("other")))
    together = (
        held.select(*PLACE, F.inline(F.flatten(F.transform("held", after))))
        .groupBy(*PLACE, "item", "other")
        .agg(F.count("*").alias("both"))
    )
    other = often.select(*PLACE, F.col("item").alias("other"), F.col("lists").alias("other_lists"))
    tabled = (
        together.join(often, [*PLACE, "item"])
        .join(other, [*PLACE, "other"])
        .withColumn("only_item", F.col("lists") - F.col("both"))
        .withColumn("only_other", F.col("other_lists") - F.col("both"))
        .withColumn("neither", F.col("population") - F.col("lists") - F.col("only_other"))
    )
    return tabled.select(
        *PLACE, "item", "other", "population", "both", "only_item", "only_other", "neither",
        share(F.col("both") + F.col("neither"), F.col("population")).alias("diagonal"),
        share(F.col("only_item") + F.col("only_other"), F.col("population")).alias("opposed"),
    )


def climbing(read: DataFrame, fringe: DataFrame) -> DataFrame:
    """Items new to the pool that a segment is still taking up."""
    order = F.struct("fresh_lists", (-F.col("qty_a")).alias("a"), (-F.col("qty_b")).alias("b"))
    rising = read.where((F.col("fresh_lists") > 0) & (F.col("delta") > 0)).join(
        fringe.select("segment", "item").distinct(), ["segment", "item"], "left_semi"
    )
    return (
        rising.groupBy(*PLACE, "item")
        .agg(
            F.sum("delta").alias("delta"),
            share(F.sum("fresh_lists"), F.max("fresh_population")).alias("adoption"),
            F.max_by(F.struct("qty_a", "qty_b", "fresh_adoption"), order).alias("lead"),
            F.max("fresh_population").alias("population"),
        )
        .select(
            *PLACE, "item", "delta", "adoption",
            F.col("lead.qty_a").alias("lead_a"), F.col("lead.qty_b").alias("lead_b"),
            F.col("lead.fresh_adoption").alias("lead_adoption"), "population",
        )
    )
