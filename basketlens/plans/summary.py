"""Datasets of a run: the dossier of every item, and the sections of a summary."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, EngineConfig
from ..functions.frames import stacked
from ..functions.shares import tilt_shown
from ..operators import composition, ledger, movement, reference
from ..operators.scope import since, windows
from ..sources import captures


def dossier(read: DataFrame, flags: DataFrame, contrasts: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Everything known of each item in each segment's challenge lists: what was
    registered, how the boards moved, which flags stand and how it finished."""
    rows = read.where((F.col("stratum") == CHALLENGE) & (F.col("fresh_lists") + F.col("baseline_lists") > 0))
    moved = movement.migration(rows, cfg).select("segment", "item", "shift", "direction")
    raised = flags.where("item IS NOT NULL").groupBy("segment", "item").agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in
          (("hype", "hype_flags"), ("fringe", "fringe_flags"), ("pet-tech", "pet_flags"))],
        F.min("first_seen").alias("first_seen"),
    )
    finished = contrasts.where("arm = 'any count'").select(
        "segment", "item", "with_made", "with_lists", "without_made", "without_lists", "difference",
        "p", "floor", "state", "gap", "uncapped", "cap_effect",
    )
    return (
        rows.select(
            "segment", "item", "qty_a", "qty_b", "fresh_lists", "fresh_population", "fresh_adoption",
            "baseline_lists", "baseline_population", "baseline_adoption", "delta",
            tilt_shown("fresh_tilt", cfg).alias("tilt_shown"),
        )
        .join(moved, ["segment", "item"], "left")
        .join(raised, ["segment", "item"], "left")
        .join(finished, ["segment", "item"], "left")
    )


def run_windows(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The windows of the run and the days left to the deadline."""
    return windows(baskets, cfg).withColumn(
        "days_to_deadline", F.datediff(F.lit(cfg.deadline).cast("date"), "as_of")
    )


def ratio_rows(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The segment split as one row a day and stratum since the epoch start."""
    part = F.struct("segment", "share", "lists")
    return (
        composition.segment_ratio(since(baskets, cfg.epoch_start))
        .groupBy("date", "stratum")
        .agg(F.array_sort(F.collect_list(part)).alias("split"))
        .orderBy(F.desc("date"), "stratum")
    )


def audit_counts(audit: DataFrame, lacking: DataFrame) -> DataFrame:
    """Core, flex and missing slots of every audited basket."""
    return (
        stacked(audit.select("owner", "version", "core", "missing"), lacking.select("owner", "version", "core", "missing"))
        .groupBy("owner", "version")
        .agg(
            F.count_if("core").alias("core"),
            F.count_if(~F.col("core") & ~F.col("missing")).alias("flex"),
            F.count_if("missing").alias("missing"),
        )
    )


def hype_watchlist(flags: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every segment's episodes, newest spike first, with the clock of each open one."""
    clocked = ledger.clocks(flags, cfg).select(
        "segment", "item", "qty_a", "qty_b", "raised_on", "answerable_on", "past_deadline", "waiting_on_evidence"
    )
    episodes = flags.where("kind = 'hype'")
    return (
        episodes.join(clocked.where("raised_on IS NOT NULL"), ["segment", "item", "qty_a", "qty_b", "raised_on"])
        .select(
            "raised_on", "item", "qty_a", "qty_b", "segment", "from_adoption", "to_adoption", "population",
            "state", "now_adoption", "standing", "origin_actor", "origin_placement", "origin_event",
            "origin_date", "answerable_on", "past_deadline", "waiting_on_evidence",
        )
        .orderBy(F.desc("raised_on"), "item", "qty_a", "qty_b")
    )


def lineage_rows(flags: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every segment's departures with their finish, their clock and what became of them."""
    closes = F.date_add("date", cfg.trendsetter_days)
    watching = F.col("followed") == "watching"
    return (
        ledger.lineage(flags)
        .withColumn("finish", F.coalesce(F.concat(F.lit("#"), F.col("placement").cast("string")), F.lit("5-0")))
        .withColumn("answerable_on", F.when(watching, closes))
        .withColumn("past_deadline", F.col("answerable_on") > F.lit(cfg.deadline).cast("date"))
    )


def sections(run) -> dict[str, Callable[[], DataFrame]]:
    """Every dataset of one run's summary, by section name, built when asked for."""
    cfg = run.cfg
    newest = lambda: captures.current(run.reference)
    audit = lambda: reference.slots(newest(), run.adoption, cfg)
    lacking = lambda: reference.missing_core(newest(), run.adoption, cfg)
    return {
        "windows": lambda: run_windows(run.baskets, cfg),
        "audit": lambda: reference.playtest_queue(audit(), lacking()),
        "audit_counts": lambda: audit_counts(audit(), lacking()),
        "unplayed": lambda: reference.unplayed(newest(), run.adoption, cfg),
        "climbing": lambda: movement.climbing(run.adoption, run.fringe).where(F.col("stratum") == CHALLENGE),
        "near_misses": lambda: composition.near_misses(
            since(run.items, cfg.epoch_start), since(run.baskets, cfg.epoch_start), cfg
        ),
        "hype": lambda: hype_watchlist(run.ledger, cfg),
        "lineage": lambda: lineage_rows(run.ledger, cfg),
        "ratio": lambda: ratio_rows(run.baskets, cfg),
        "trend": lambda: composition.share_trend(run.snapshots, cfg.share_cohort, cfg.share_window_days),
    }


def write_sections(datasets: dict[str, Callable[[], DataFrame]], folder: str, run_date: str) -> None:
    """One dataset a section under the run's own date."""
    for name, build in datasets.items():
        build().write.mode("overwrite").parquet(f"{folder}/{name}/run_date={run_date}")
