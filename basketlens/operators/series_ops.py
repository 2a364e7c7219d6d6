"""Orders a reading is walked or reported in."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_order(lists: DataFrame) -> DataFrame:
    """Lists by day, then actor, then list. The order is total, so the sort cuts
    even one crowded day into ranges."""
    return lists.select("list_id", "date", "actor").orderBy("date", "actor", "list_id")


def both_ends(read: DataFrame, ends: int | None = None) -> DataFrame:
    """Items by how overrepresented they are among lists off each target, ranked
    from either end. With `ends`, only so many from each end, and `left_out` says
    how many of the target's items that leaves out."""
    split = Window.partitionBy("segment", "stratum", "target", "target_a", "target_b")
    top = F.row_number().over(split.orderBy(F.desc("shown"), "item"))
    bottom = F.row_number().over(split.orderBy("shown", F.desc("item")))
    # Rounded before ordering, so equal differences tie and the name decides.
    ranked = (
        read.withColumn("shown", F.round("difference", 9))
        .withColumn("from_top", top)
        .withColumn("from_bottom", bottom)
        .withColumn("items", F.col("from_top") + F.col("from_bottom") - 1)
        .drop("shown")
    )
    if ends is None:
        return ranked.withColumn("left_out", F.lit(0)).drop("items")
    cut = F.greatest(F.lit(0), F.col("items") - 2 * ends)
    return ranked.where(F.least("from_top", "from_bottom") <= ends).withColumn("left_out", cut).drop("items")
