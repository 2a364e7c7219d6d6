"""Tracked questions: what the data says about each question's subjects.

`subjects(hypothesis_id, subject, conditional_on)` holds an item name, or the
word for the list-level total, a row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, EngineConfig
from ..functions.frames import stacked
from .composition import share_as_of

TOTAL_SUBJECT = "lands"
MIRROR = "mirror"
HYPE_CAVEAT = "adoption behind a hyped finish is not evidence about the item"


def _fresh(read: DataFrame) -> DataFrame:
    return read.where((F.col("stratum") == CHALLENGE) & (F.col("fresh_lists") > 0))


def readings(subjects: DataFrame, read: DataFrame, totals: DataFrame) -> DataFrame:
    """Every configuration of every subject each segment is currently on."""
    kept = ["segment", "configuration", "fresh_population", "fresh_adoption", "fresh_tilt", "delta"]
    of_items = _fresh(read).withColumn("configuration", F.concat_ws("/", "qty_a", "qty_b"))
    of_total = _fresh(totals).withColumn("configuration", F.col("typed_total").cast("string"))
    spoken = stacked(
        of_items.select(F.col("item").alias("subject"), *kept),
        of_total.select(F.lit(TOTAL_SUBJECT).alias("subject"), *kept),
    )
    return subjects.join(spoken, "subject").select(
        "hypothesis_id", "subject", "segment", "configuration",
        F.col("fresh_population").alias("population"),
        F.col("fresh_adoption").alias("adoption"),
        F.col("fresh_tilt").alias("tilt"), "delta",
    )


def quiet(subjects: DataFrame, spoken: DataFrame, pool: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Subjects with no reading in a segment: silent where the cohort ever
    registered one, unknown where it never did."""
    key = ["hypothesis_id", "subject", "segment"]
    segments = F.array(*[F.lit(name) for name in (*cfg.segment_names, cfg.hybrid_segment)])
    still = subjects.withColumn("segment", F.explode(segments)).join(spoken.select(*key).distinct(), key, "left_anti")
    known = pool.select(F.col("item").alias("subject"), F.lit(True).alias("known"))
    found = F.coalesce(F.col("known"), F.lit(False)) | (F.col("subject") == TOTAL_SUBJECT)
    return still.join(known, "subject", "left").select(
        *key, F.when(found, F.lit("silent")).otherwise(F.lit("unknown")).alias("reading")
    )


def flagged(subjects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Flags raised on the subjects in each segment; a hyped one carries a caveat."""
    raised = ledger.where("item IS NOT NULL").select(
        "segment", "kind", F.col("item").alias("subject"), F.concat_ws("/", "qty_a", "qty_b").alias("configuration"),
        "state", F.col("first_seen").alias("raised"),
        F.when(F.col("kind") == "hype", F.lit(HYPE_CAVEAT)).alias("caveat"),
    )
    return subjects.join(raised, "subject").select(
        "hypothesis_id", "subject", "segment", "kind", "configuration", "state", "raised", "caveat"
    )


def evidence(
    subjects: DataFrame, read: DataFrame, totals: DataFrame, pool: DataFrame, ledger: DataFrame,
    snapshots: DataFrame, on: DataFrame, cfg: EngineConfig,
) -> dict[str, DataFrame]:
    """One dated evidence batch for every question at once.

    `on(day)` is the day the batch is dated. A conditional question reads the
    share that stood that day, and says so where none did.
    """
    spoken = readings(subjects, read, totals)
    stood = share_as_of(on, snapshots, cfg.share_cohort, cfg.share_window_days)
    asked = subjects.select("hypothesis_id", "conditional_on").distinct()
    # A batch has one day, so the as-of reading is a single row.
    reading = stood.select(F.struct("captured_on", "window_days", "share", "deck_count")).scalar()
    mirror = (
        asked.withColumn("stood", F.when(F.col("conditional_on") == MIRROR, reading))
        .select(
            "hypothesis_id", "conditional_on", "stood.captured_on", "stood.window_days", "stood.share",
            "stood.deck_count",
            (F.col("conditional_on").isNotNull() & F.col("stood.captured_on").isNull()).alias("unconditioned"),
        )
    )
    return {
        "readings": spoken,
        "quiet": quiet(subjects, spoken, pool, cfg),
        "flags": flagged(subjects, ledger),
        "mirror": mirror,
    }
