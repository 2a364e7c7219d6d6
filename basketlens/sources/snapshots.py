"""Dated share tables: CSV readings kept as published, read as shares."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.dates import strict_date
from ..functions.shares import resolve_alias

# The columns a kept reading carries, in order.
FIELDS = ("captured_on", "window_days", "archetype", "meta_pct", "deck_count")
TABLE_SCHEMA = ", ".join(f"{name} string" for name in FIELDS)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every kept reading as text. A file whose header is not exactly the one a
    reading carries fails the scan instead of being passed over."""
    return (
        spark.read.schema(TABLE_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .csv(folder)
    )


def shares(readings: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Readings as shares, cohorts published under two names summed into one."""
    day = strict_date("captured_on")
    refused = F.raise_error(F.concat(F.lit("not an ISO day: "), F.col("captured_on"))).cast("date")
    return (
        readings.select(
            F.coalesce(day, refused).alias("captured_on"),
            F.col("window_days").cast("int").alias("window_days"),
            resolve_alias(F.col("archetype"), cfg.share_aliases).alias("cohort"),
            (F.col("meta_pct").cast("double") / 100).alias("share"),
            F.col("deck_count").cast("int").alias("deck_count"),
        )
        .groupBy("captured_on", "window_days", "cohort")
        .agg(F.sum("share").alias("share"), F.sum("deck_count").alias("deck_count"))
    )


def stamped(table: DataFrame, captured_on: str, window_days: int) -> DataFrame:
    """A transcribed table as the reading it is, or a refusal.

    The date must be one, the table must hold rows, and a table that already
    says which reading it is must say this one. The check is one small
    aggregate; the rows never leave the cluster.
    """
    spark = table.sparkSession
    day = spark.range(1).select(strict_date(F.lit(captured_on))).first()[0]
    if day is None:
        raise ValueError(f"{captured_on} is not an ISO day")
    for name in ("captured_on", "window_days"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast("string"))
    other = (F.col("captured_on") != captured_on) | (F.col("window_days") != str(window_days))
    half = F.col("captured_on").isNull() != F.col("window_days").isNull()
    seen = table.agg(F.count("*").alias("rows"), F.count_if(other | half).alias("disagree")).first()
    if not seen["rows"]:
        raise ValueError("the table holds no cohorts")
    if seen["disagree"]:
        raise ValueError(f"the table is stamped otherwise than {captured_on} over {window_days} days")
    return table.select(
        F.lit(captured_on).alias("captured_on"), F.lit(str(window_days)).alias("window_days"),
        "archetype", "meta_pct", "deck_count",
    )


def ingest(table: DataFrame, captured_on: str, window_days: int, folder: str) -> str:
    """File one reading under its own two terms; filing it again replaces it alone."""
    path = f"{folder}/{captured_on}_{window_days}d"
    stamped(table, captured_on, window_days).write.mode("overwrite").option("header", True).csv(path)
    return path
