"""Sliding fortnight tallies over an event stream.

Two ways to run them: `run_to_end` keeps every window open and serves all as they
stand, whatever order files come in; `run_closed` waits for late rows as long as
days stay unsettled, gives each window out once when it closes and forgets it.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..session import fresh_path

# Windows close at the end of a Sunday: the epoch day was a Thursday.
SUNDAY_OFFSET = "4 days"


def sliding(events: DataFrame, keys: list[str], cfg: EngineConfig) -> DataFrame:
    """Counts per key and window of `hype_window_days` ending each Sunday."""
    span = F.window("ts", f"{cfg.hype_window_days} days", "7 days", SUNDAY_OFFSET)
    return (
        events.groupBy(span.alias("w"), *keys)
        .agg(F.count("*").alias("lists"))
        .select(F.to_date(F.date_sub(F.to_date("w.end"), 1)).alias("end"), *keys, "lists")
    )


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of parts.

    No watermark: the state is a count per Sunday and event type, which the
    calendar bounds, so no row comes too late to count.
    """
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")


def run_to_end(tally: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Drain a tally and serve every window as it stands, open ones too.

    Each batch writes the counts it changed under its own number; the highest
    number of a key is its count.
    """
    spark = tally.sparkSession
    root = fresh_path(spark, name)
    sink = f"{root}/sink"

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = (
        tally.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).foreachBatch(put).start()
    )
    query.awaitTermination()
    stood = spark.read.schema(tally.schema.add("batch", "long")).parquet(sink)
    return stood.groupBy("end", *keys).agg(F.max_by("lists", "batch").alias("lists"))


@dataclass(frozen=True)
class Closed:
    """Windows that have closed, what came too late for them, and how many counts each batch left in the state."""

    windows: DataFrame
    late: DataFrame
    state_rows: list[int]


def run_closed(events: DataFrame, keys: list[str], cfg: EngineConfig, root: str) -> Closed:
    """Drain a stream of ts and keys: a window is given out when the latest time seen
    is `unsettled_days` past its end. Its count leaves the state then, so the state
    holds the open windows only, however long the stream runs.

    A row that comes when one of its windows has closed is counted apart for that
    window; closed and late counts together are those of one batch over everything.
    A restart goes on from the checkpoints under `root`.
    """
    spark = events.sparkSession
    settle = f"{cfg.unsettled_days} days"
    span = F.window("ts", f"{cfg.hype_window_days} days", "7 days", SUNDAY_OFFSET)

    def put(closed: DataFrame, number: int) -> None:
        closed.write.mode("overwrite").parquet(f"{root}/closed/batch={number}")

    def apart(arrived: DataFrame, number: int) -> None:
        # The same bound as the tally's watermark: the latest time of the batches before this one.
        path = f"{root}/reached/batch={number - 1}"
        before = spark.read.schema("ts timestamp").parquet(path).first().ts if number else None
        edge = F.lit(before).cast("timestamp") - F.expr(f"interval {settle}")
        over = arrived.select(span.alias("w"), *keys).where(F.col("w.end") <= edge)
        counted = over.groupBy("w", *keys).agg(F.count("*").alias("lists"))
        counted.select(F.to_date(F.date_sub(F.to_date("w.end"), 1)).alias("end"), *keys, "lists").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        arrived.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("ts")).write.mode("overwrite").parquet(f"{root}/reached/batch={number}")

    tally = sliding(events.withWatermark("ts", settle), keys, cfg)
    start = lambda frame, name, do: (
        frame.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state-{name}").trigger(availableNow=True).foreachBatch(do).start()
    )
    # One stateful step needs no second, older bound for late rows, which is what this setting would add.
    several = "spark.sql.streaming.statefulOperator.allowMultiple"
    was = spark.conf.get(several)
    spark.conf.set(several, "false")
    try:
        main = start(tally, "tally", put)
        main.awaitTermination()
    finally:
        spark.conf.set(several, was)
    rows = [sum(op["numRowsTotal"] for op in progress["stateOperators"]) for progress in main.recentProgress]
    start(events, "late", apart).awaitTermination()
    shape = tally.schema
    stored = lambda name: spark.read.schema(shape).parquet(f"{root}/{name}").select(*shape.names)
    return Closed(stored("closed"), stored("late"), rows)
