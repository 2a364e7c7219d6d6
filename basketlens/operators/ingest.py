"""What an ingest brought in: the index of published lists and its difference."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.frames import stacked
from ..session import settled

INDEX_COLUMNS = ("date", "event_id", "event_class", "actor", "placement", "points")


def index_rows(baskets: DataFrame) -> DataFrame:
    """One text row per published list, absence as empty text, free of any rule."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INDEX_COLUMNS]
    return baskets.select(*text)


def ordered(index: DataFrame) -> DataFrame:
    """Chronological, unranked lists after an event's finishes, placement as a number."""
    rank = F.nullif(F.col("placement"), F.lit("")).cast("int")
    return index.orderBy("date", "event_id", F.asc_nulls_last(rank), "actor")


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of one index the other does not account for, counted: two equal rows
    are two lists."""
    return after.select(*INDEX_COLUMNS).exceptAll(before.select(*INDEX_COLUMNS))


def arrivals(added: DataFrame, baskets: DataFrame) -> DataFrame:
    """Cohort lists among what arrived, by day, event and actor."""
    keys = added.select(F.to_date("date").alias("date"), "event_id", "actor").distinct()
    return baskets.where("member").join(keys, ["date", "event_id", "actor"], "left_semi").select(
        "list_id", "date", "event_id", "event", "actor", "placement", "segment"
    )


def summary(added: DataFrame, withdrawn: DataFrame, ours: DataFrame) -> DataFrame:
    """Counts of one ingest: lists and events in, cohort lists in, lists gone."""
    parts = [
        added.select(F.lit("added").alias("part"), "event_id"),
        withdrawn.select(F.lit("withdrawn").alias("part"), "event_id"),
        ours.select(F.lit("cohort").alias("part"), "event_id"),
    ]
    of = lambda name: F.col("part") == name
    return stacked(*parts).agg(
        F.count_if(of("added")).alias("added"),
        F.countDistinct(F.when(of("added"), F.col("event_id"))).alias("events"),
        F.count_if(of("cohort")).alias("cohort_added"),
        F.count_if(of("withdrawn")).alias("withdrawn"),
    )


def named_arrivals(ours: DataFrame, limit: int | None = None) -> DataFrame:
    """Arrivals by name, newest first. With a limit only so many, each row saying
    how many more there are."""
    newest = ours.orderBy(F.desc("date"), F.asc_nulls_last("placement"), "actor", "list_id")
    if limit is None:
        return newest.withColumn("and_more", F.lit(0).cast("long"))
    total = ours.agg(F.count("*")).scalar()
    return newest.limit(limit).withColumn("and_more", F.greatest(F.lit(0), total - limit))


def to_refresh(published: DataFrame, held: DataFrame, today, cfg: EngineConfig) -> DataFrame:
    """Published events to read again: those not held yet, and those of the last
    unsettled days, which still gain lists. A range past today ends today."""
    end = F.lit(today).cast("date") if isinstance(today, str) else today
    unsettled = published.where(
        (F.col("date") >= F.date_sub(end, cfg.unsettled_days)) & (F.col("date") <= end)
    )
    gaps = published.where(F.col("date") < F.date_sub(end, cfg.unsettled_days)).join(
        held.select("event_id").distinct(), "event_id", "left_anti"
    )
    return stacked(unsettled, gaps.select(*published.columns))


INDEX_SCHEMA = "date string, event_id string, event_class string, actor string, placement string, points string, month string"


def write_index(index: DataFrame, path: str) -> None:
    """The index by month, so that a later ingest replaces months and leaves the rest."""
    _by_month(index).parquet(path)


def _by_month(index: DataFrame, mode: str = "static"):
    """A writer into months, each cut by day among tasks."""
    rows = index.select(*INDEX_COLUMNS, F.substring("date", 1, 7).alias("month")).repartition("month", "date")
    return rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def refresh(path: str, published: DataFrame, today, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Bring the index at a path up to what is published and return what that
    added and what it withdrew.

    Unsettled days become what is published of them; on settled days only events
    not held yet are added. Only months with such a day are rewritten, by dynamic
    overwrite; what stood in them is settled first, since it is read from there.
    """
    spark = published.sparkSession
    held = read_index(spark, path)
    end = F.lit(today).cast("date") if isinstance(today, str) else today
    again = to_refresh(published.withColumn("date", F.to_date("date")), held, end, cfg).withColumn("date", F.col("date").cast("string"))
    settled_day = F.to_date("date") < F.date_sub(end, cfg.unsettled_days)
    months = again.select(F.substring("date", 1, 7).alias("month")).unionByName(held.where(~settled_day).select("month")).distinct()
    before = settled(held.join(months, "month", "left_semi").select(*INDEX_COLUMNS), "index-before")
    after = settled(stacked(before.where(settled_day), again.select(*INDEX_COLUMNS)), "index-after")
    month = F.substring("date", 1, 7).alias("month")
    if not before.select(month).distinct().join(after.select(month).distinct(), "month", "left_anti").isEmpty():
        # A month that lost every list has no rows to overwrite it with: the index without it is written anew.
        rest = settled(stacked(held.join(months, "month", "left_anti").select(*INDEX_COLUMNS), after), "index-whole")
        _by_month(rest).parquet(path)
    else:
        _by_month(after, "dynamic").parquet(path)
    return difference(after, before), difference(before, after)
