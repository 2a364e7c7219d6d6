"""Published events as a stream: lists as they land, copies of an event dropped."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled
from ..sources import payload


def read_landing(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(payload.PAYLOAD_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


LANDED = ["event_id", "pos"]


def arriving_lists(payloads: DataFrame) -> DataFrame:
    """Lists of arriving payloads; the finish is matched inside the payload's own row."""
    return payload.listed(payloads).select(
        "list_id", "event_id", "event", "event_class", "pos", F.col("deck.player").alias("actor"),
        F.to_timestamp("day", "yyyy-MM-dd").alias("event_ts"),
    )


def land(lists: DataFrame, sink: str, state: str, grain: str = "day", unsettled_days: int = 3) -> DataFrame:
    """Drain arriving lists to a table and serve it. An event landing again adds
    only lists at places it did not have before, however late and in whatever
    order its files come; `late` marks lists of days that were settled when they came.

    Every day (or month) of events is a folder of its own, and a batch looks its
    lists up in the folders of its own days. What it reads thus grows with its days
    and not with all that has landed before, and settled days aren't held in memory.
    Spark's own operator for duplicates within a watermark would throw away every
    list behind the watermark, also one that fills a gap.

    A batch is written under its own number, so one that runs again replaces itself.
    """
    spark = lists.sparkSession
    stored = T.StructType([*lists.schema.fields, T.StructField("late", T.BooleanType())])
    part = F.date_format("event_ts", {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[grain])

    def add(batch: DataFrame, number: int) -> None:
        # Three readers below: the batch's texts are read and parsed for one of them.
        arrived = settled(batch, "arrived")
        once = arrived.dropDuplicates(LANDED).withColumn("part", F.coalesce(part, F.lit("undated")))
        # As many rows as the batch has days.
        days = [row.part for row in once.select("part").distinct().collect()]
        known = read_landed(spark, sink, stored, days).where(F.col("batch") != number).select(*LANDED)
        before = _last_day(spark, sink, number - 1)
        late = F.coalesce(F.col("event_ts") < F.date_sub(F.lit(before).cast("date"), unsettled_days), F.lit(False))
        fresh = once.join(known, LANDED, "left_anti").withColumn("late", late).withColumn("batch", F.lit(number).cast("long"))
        rows = fresh.hint("rebalance", "part")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{sink}/lists")
        last = arrived.agg(F.greatest(F.max(F.to_date("event_ts")), F.lit(before).cast("date")).alias("day"))
        last.write.mode("overwrite").parquet(f"{sink}/last/batch={number}")

    query = lists.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()
    return read_landed(spark, sink, stored).drop("batch")


def _last_day(spark: SparkSession, sink: str, number: int):
    """The last day of events that any batch up to this one brought."""
    path = f"{sink}/last/batch={number}"
    return spark.read.schema("day date").parquet(path).first().day if _exists(spark, path) else None


def read_landed(spark: SparkSession, sink: str, schema: T.StructType, parts: list[str] | None = None) -> DataFrame:
    """The table of what has landed, or of some of its days; empty before the first batch."""
    root = f"{sink}/lists"
    paths = [root] if parts is None else [f"{root}/part={name}" for name in parts]
    there = [path for path in paths if _exists(spark, path)]
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not there:
        return spark.createDataFrame([], whole)
    return spark.read.schema(T.StructType([*whole.fields, T.StructField("part", T.StringType())])).option("basePath", root).parquet(*there).drop("part")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
