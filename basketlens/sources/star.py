"""The star schema read as baskets: an order is a basket, its parts are items.

| model                | from                                                       |
|----------------------|------------------------------------------------------------|
| list_id, actor, date | order key, customer key, order day                         |
| event                | month and priority; the three low priorities are leagues   |
| placement, points    | challenge events only: rank by price, three points per 50k |
| item                 | two rows per line, the part's type and its brand           |
| qty_a / qty_b        | lines of that item with status F / O                       |
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LEAGUE, EngineConfig
from ..functions.dates import week_end
from ..functions.frames import stacked
from ..functions.shares import resolve_alias, share
from ..session import settled

LEAGUE_PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM")
POINTS_STEP = 50_000
LINES_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked_in_event(finishes: DataFrame, buckets: int) -> DataFrame:
    """Placement by falling price inside each event, ties to the smaller id.

    An event may hold a large part of all lists, so no task ranks a whole one:
    lists are cut into even ranges of event, price and id, whatever the prices,
    each event is ranked inside its ranges, and the sizes of the dearer ranges are
    added on.
    """
    placed = settled(in_ranges(finishes, buckets), "price-ranges")
    dearer = Window.partitionBy("event_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        placed.groupBy("event_id", "bucket")
        .agg(F.count("*").alias("size"))
        .select("event_id", "bucket", F.coalesce(F.sum("size").over(dearer), F.lit(0)).alias("ahead"))
    )
    inside = Window.partitionBy("event_id", "bucket").orderBy(F.desc("price"), "list_id")
    return (
        placed.withColumn("inside", F.row_number().over(inside))
        .join(ahead, ["event_id", "bucket"])
        .withColumn("placement", (F.col("ahead") + F.col("inside")).cast("int"))
        .drop("bucket", "ahead", "inside")
    )


def in_ranges(finishes: DataFrame, ranges: int) -> DataFrame:
    """Lists with the range they fall into; the id in the key cuts even equal prices."""
    cut = finishes.repartitionByRange(ranges, "event_id", F.desc("price"), "list_id")
    return cut.withColumn("bucket", F.spark_partition_id())


def raw_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published lists with their provenance, before any rule is read over them."""
    league = F.col("o_orderpriority").isin(*LEAGUE_PRIORITIES)
    month = F.date_format("o_orderdate", "yyyy-MM")
    lists = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("list_id"),
        F.col("o_custkey").cast("string").alias("actor"),
        F.concat_ws(" ", "o_orderpriority", month).alias("event"),
        F.concat_ws("/", month, "o_orderpriority").alias("event_id"),
        F.when(league, F.lit(LEAGUE)).otherwise(F.col("o_orderpriority")).alias("event_class"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    challenge = ranked_in_event(lists.where(F.col("event_class") != LEAGUE), buckets).withColumn(
        "points", (3 * F.floor(F.col("price") / POINTS_STEP)).cast("int")
    )
    ranked = stacked(lists.where(F.col("event_class") == LEAGUE), challenge)
    return ranked.withColumn("record", F.when(F.col("status") == "F", F.lit("5-0"))).drop("price")


def item_entries(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One row per registered entry: the line's type and brand, on its board.

    `dealt` puts the lines of a list into one task before they are laid out as
    entries, for readers that count and gather by list: nothing moves again then.
    Lines pack well and count many times that size in memory, so tasks are dealt by
    the number of lines and not by bytes: what a task holds doesn't grow with the table.

    Parts grow with the tables and take many times their file's size in memory, so
    they are met in a sorted join and never sent whole through the driver.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("list_id"), "l_partkey", F.col("l_linestatus").alias("status")
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(
            F.struct(F.concat(F.lit("type:"), "p_type").alias("name"), F.col("p_type").alias("type")),
            F.struct(F.concat(F.lit("brand:"), "p_brand").alias("name"), F.lit("BRAND").alias("type")),
        ).alias("entries"),
    )
    board = F.when(F.col("status") == "F", F.lit("a")).otherwise(F.lit("b"))
    met = lines.join(parts.hint("merge"), lines.l_partkey == parts.p_partkey).select("list_id", board.alias("board"), "entries")
    if dealt:
        met = met.repartition(_tasks(spark, lines), "list_id")
    return met.select("list_id", "board", F.lit(1).alias("qty"), F.inline("entries"))


def _tasks(spark: SparkSession, lines: DataFrame) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))


def share_snapshots(spark: SparkSession, sf_dir: str, cfg: EngineConfig) -> DataFrame:
    """Dated shares of every event type: one reading a day over one day, and one
    each Sunday over the week it closes. The two lengths are never pooled."""
    seen = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"),
        resolve_alias(F.col("event_type"), cfg.share_aliases).alias("cohort"),
    )
    daily = seen.groupBy("day", "cohort").agg(F.count("*").alias("deck_count"))
    readings = daily.select(
        "cohort",
        "deck_count",
        F.inline(
            F.array(
                F.struct(F.col("day").alias("captured_on"), F.lit(1).alias("window_days")),
                F.struct(week_end(F.col("day")).alias("captured_on"), F.lit(7).alias("window_days")),
            )
        ),
    )
    counted = readings.groupBy("captured_on", "window_days", "cohort").agg(
        F.sum("deck_count").alias("deck_count")
    )
    field = Window.partitionBy("captured_on", "window_days")
    return counted.withColumn("share", share(F.col("deck_count"), F.sum("deck_count").over(field)))
