"""The store: classified baskets, their item rows and the share snapshots.

Derived data, rebuilt whole and never edited. Both tables are cut by month and
lie in order of day and list, so a window's dates prune files and row groups; a
crowded month splits over many files.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shares import resolve_alias
from ..operators.scope import LIST_COLUMNS, by_marks, finish_weights, marked
from ..session import fresh_path, written


@dataclass(frozen=True)
class Store:
    baskets: DataFrame
    items: DataFrame
    snapshots: DataFrame
    cfg: EngineConfig


def count_items(entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Copies per list and canonical item name, a board each; an absent board is 0.

    Two printings of one item in a list are one item. The sums combine before
    the shuffle, so a list of any size moves one row per item and task. Board-a
    copies of the configured type ride along for the list's total.
    """
    on_a = F.col("board") == "a"
    return (
        entries.withColumn("item", resolve_alias(F.col("name"), cfg.item_aliases))
        .groupBy("list_id", "item")
        .agg(
            F.coalesce(F.sum(F.when(on_a, F.col("qty"))), F.lit(0)).cast("int").alias("qty_a"),
            F.coalesce(F.sum(F.when(~on_a, F.col("qty"))), F.lit(0)).cast("int").alias("qty_b"),
            F.coalesce(F.sum(F.when(on_a & is_typed(cfg), F.col("qty"))), F.lit(0)).cast("int").alias("typed_a"),
        )
    )


def is_typed(cfg: EngineConfig):
    return F.trim(F.coalesce(F.col("type"), F.lit(""))) == cfg.typed_label


def typed_totals(entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Board-a copies a list runs of entries of the configured type."""
    return (
        entries.where(is_typed(cfg) & (F.col("board") == "a"))
        .groupBy("list_id")
        .agg(F.sum("qty").cast("int").alias("typed_total"))
    )


def typed_items(entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every item the source itself gives the configured type, on either board."""
    return (
        entries.where(is_typed(cfg))
        .select(resolve_alias(F.col("name"), cfg.item_aliases).alias("item"))
        .distinct()
    )


def gathered(counted: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row a list: its marks, and its counted items as one value.

    Items are counted before they are gathered, so the value is as long as the list
    has distinct items, however often it names them.
    """
    rows = F.collect_list(F.struct("item", "qty_a", "qty_b")).alias("held")
    return counted.groupBy("list_id").agg(*marked(cfg), rows)


def clustered(frame: DataFrame) -> DataFrame:
    """Rows dealt by month, large months cut among tasks, in order of day and list inside a task."""
    month = F.date_format("date", "yyyy-MM")
    return frame.withColumn("month", month).hint("rebalance", "month").sortWithinPartitions("date", "list_id").drop("month")


def build(
    baskets: DataFrame, entries: DataFrame, snapshots: DataFrame, cfg: EngineConfig, root: str | None = None
) -> Store:
    """The store over raw lists and entries.

    A list takes its items along as one value while it is labelled and put in order,
    so what moves is a row a list and not the list's columns once an item; the two
    tables are then laid out of that one, where it lies.

    Given a root each table is written there as soon as it stands, under a new
    version directory: entries are read once however often their counts are, a
    lost executor re-reads files, and no reader sees half a store. Without one
    the store is a lazy plan.
    """

    def keep(frame: DataFrame, name: str, by_day: bool = False) -> DataFrame:
        if root is None:
            return frame
        return written(clustered(frame) if by_day else frame, f"{root}/{name}")

    lists = gathered(count_items(entries, cfg), cfg)
    labelled = by_marks(finish_weights(baskets).join(lists.hint("merge"), "list_id", "left"), cfg)
    whole = keep(labelled, "lists", by_day=True)
    listed = keep(whole.drop("held"), "baskets")
    items = keep(whole.select("list_id", F.inline("held"), *[c for c in LIST_COLUMNS if c != "list_id"]), "basket_items")
    return Store(listed, items, keep(snapshots, "share_snapshots"), cfg)


def materialise(
    spark: SparkSession, baskets: DataFrame, entries: DataFrame, snapshots: DataFrame, cfg: EngineConfig
) -> Store:
    """The store written to the session's shared folder, or lazy where it names none."""
    return build(baskets, entries, snapshots, cfg, fresh_path(spark, "store"))
