"""The engine over the star schema: one store per session, then its readings.

Readings several reports share are settled once a session, as the ledger of a
run is recorded once and then only read.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STAR, EngineConfig
from ..operators import (
    actors, adoption, composition, departures, hype, ledger, novelty, outcome, subjects, weekly,
)
from ..session import fresh_path, guarded, settled
from ..sources import episodes, ledgers, standing, star
from ..sources.standing import Refreshed, Standing
from ..sources.store import Store, materialise, typed_items
from ..sources.versions import Versions
from . import derived


class StarRun:
    """One session's readings over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: EngineConfig = STAR):
        self.spark, self.sf_dir, self.cfg = guarded(spark), sf_dir, cfg

    def table(self, name: str) -> DataFrame:
        return star.table(self.spark, self.sf_dir, name)

    @cached_property
    def store(self) -> Store:
        """The store of this session, built at the first reading."""
        return materialise(
            self.spark,
            star.raw_baskets(self.spark, self.sf_dir),
            star.item_entries(self.spark, self.sf_dir, dealt=True),
            star.share_snapshots(self.spark, self.sf_dir, self.cfg),
            self.cfg,
        )

    @property
    def baskets(self) -> DataFrame:
        return self.store.baskets

    @property
    def items(self) -> DataFrame:
        return self.store.items

    @property
    def snapshots(self) -> DataFrame:
        return self.store.snapshots

    @cached_property
    def landing(self) -> str:
        """Where the published payloads lie as files."""
        return derived.land_payloads(self)

    @cached_property
    def logs(self) -> DataFrame:
        """Match logs, scanned from their files."""
        return derived.landed_logs(self)

    @cached_property
    def adoption(self) -> DataFrame:
        return settled(adoption.adoption(self.items, self.baskets, self.cfg), "adoption")

    @cached_property
    def totals(self) -> DataFrame:
        return settled(adoption.totals(self.baskets, self.cfg), "totals")

    @cached_property
    def days(self) -> tuple[DataFrame, DataFrame]:
        """Counts a day, of configurations and of segments."""
        return settled(hype.tally_by_day(self.items), "day-tallies"), settled(hype.population_by_day(self.baskets), "day-populations")

    @cached_property
    def novelty(self) -> DataFrame:
        return settled(novelty.novelty(self.items, self.baskets, self.cfg), "novelty")

    @cached_property
    def hype(self) -> DataFrame:
        return settled(hype.hype(self.items, self.baskets, self.cfg, self.days), "hype")

    @cached_property
    def fringe(self) -> DataFrame:
        return settled(novelty.fringe_flags(self.items, self.baskets, self.cfg, self.novelty), "fringe")

    @cached_property
    def pets(self) -> DataFrame:
        return settled(actors.pet_items(self.items, self.baskets, self.cfg), "pets")

    @cached_property
    def candidates(self) -> DataFrame:
        return settled(departures.candidates(self.items, self.baskets, self.cfg, self.novelty), "candidates")

    @cached_property
    def departures(self) -> DataFrame:
        return settled(departures.departed(self.candidates, self.cfg), "departures")

    @cached_property
    def breakthroughs(self) -> DataFrame:
        found = departures.breakthroughs(self.items, self.baskets, self.cfg, self.departures)
        return settled(found, "breakthroughs")

    @cached_property
    def contrasts(self) -> DataFrame:
        return settled(outcome.contrasts(self.items, self.baskets, self.cfg), "contrasts")

    @cached_property
    def binned(self) -> DataFrame:
        return settled(weekly.binned_lists(self.items, self.baskets, self.cfg), "binned")

    @cached_property
    def weekly_averages(self) -> DataFrame:
        typed = typed_items(star.item_entries(self.spark, self.sf_dir), self.cfg)
        return settled(weekly.weekly_averages(self.items, self.binned, typed, self.cfg), "weekly")

    @cached_property
    def refresh(self) -> tuple[Versions, Refreshed]:
        """A standing store built from an earlier publication and refreshed to the last day, and what the refresh did."""
        raw = settled(star.raw_baskets(self.spark, self.sf_dir), "published")
        entries = star.item_entries(self.spark, self.sf_dir)
        today = raw.agg(F.max("date")).scalar()
        first, second = derived.two_publications(raw, today, self.cfg.unsettled_days)
        versions = Versions(self.spark, fresh_path(self.spark, "standing"))
        standing.build(versions, first, entries, self.cfg, "month")
        return versions, standing.refresh(versions, second, entries, today, self.cfg, "month")

    @cached_property
    def refreshed(self) -> Standing:
        return standing.open_store(self.refresh[0], self.cfg)

    @cached_property
    def refreshed_episodes(self) -> DataFrame:
        """Accepted leaps of the first version, folded on by what the refresh wrote."""
        versions, done = self.refresh
        home = Versions(self.spark, fresh_path(self.spark, "episodes"))
        with standing.open_store(versions, self.cfg, 1) as first:
            episodes.advance(home, first.tallies, first.populations, [], self.cfg)
        episodes.advance(home, self.refreshed.tallies, self.refreshed.populations, done.parts, self.cfg)
        return episodes.load(home)

    @property
    def last_day(self):
        return self.baskets.agg(F.max("date")).scalar()

    @property
    def earlier_day(self):
        """The day of the earlier of the two runs: the last before the fresh window."""
        return F.date_sub(self.last_day, self.cfg.fresh_days)

    def earlier(self, frame: DataFrame) -> DataFrame:
        return frame.where(F.col("date") <= self.earlier_day)

    @cached_property
    def ledger_versions(self) -> Versions:
        """Where the run's ledger lies. A user names a folder that outlives the session; a run of the queries has one of its own."""
        return Versions(self.spark, fresh_path(self.spark, "ledger"))

    @cached_property
    def earlier_ledger(self) -> DataFrame:
        """What an earlier run of every detector recorded, read back from where it was filed.

        Its counts of days, novelty and departures are those of today up to its day,
        since all of them look back only.
        """
        items, baskets = self.earlier(self.items), self.earlier(self.baskets)
        found = ledger.unified([
            hype.hype(items, baskets, self.cfg, tuple(self.earlier(days) for days in self.days)),
            novelty.fringe_flags(items, baskets, self.cfg, self.earlier(self.novelty)),
            actors.pet_items(items, baskets, self.cfg),
            departures.breakthroughs(items, baskets, self.cfg, self.earlier(self.departures)),
        ])
        ledgers.record(self.ledger_versions, found, self.earlier_day)
        return ledgers.load(self.ledger_versions, 1)[0]

    @cached_property
    def ledger(self) -> DataFrame:
        """The ledger after a run over everything, on top of the earlier one."""
        found = ledger.unified([self.hype, self.fringe, self.pets, self.breakthroughs])
        assert self.earlier_ledger is not None
        return ledgers.load(self.ledger_versions, ledgers.record(self.ledger_versions, found, self.last_day))[0]

    @cached_property
    def reference(self) -> DataFrame:
        return settled(reference_items(self.items, self.baskets, self.cfg), "reference")

    @cached_property
    def subjects(self) -> DataFrame:
        return tracked_subjects(self.table("part"))

    @cached_property
    def pool(self) -> DataFrame:
        return composition.item_pool(self.items)

    @property
    def dated(self) -> DataFrame:
        """The one day an evidence batch is dated: the last snapshot's."""
        return self.snapshots.agg(F.max("captured_on").alias("day"))

    @cached_property
    def evidence(self) -> dict[str, DataFrame]:
        return subjects.evidence(
            self.subjects, self.adoption, self.totals, self.pool, self.ledger, self.snapshots,
            self.dated, self.cfg,
        )


_RUNS: dict[tuple, StarRun] = {}


def run(spark: SparkSession, sf_dir: str, cfg: EngineConfig = STAR) -> StarRun:
    key = (spark.sparkContext.applicationId, sf_dir, cfg)
    if key not in _RUNS:
        _RUNS[key] = StarRun(spark, sf_dir, cfg)
    return _RUNS[key]


def reference_items(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A reference basket per actor: version 1 its first cohort basket, version 2
    its latest. An item version 2 dropped is written down there at no copies.

    First and latest are aggregates, so an actor of any size is never sorted.
    """
    ends = F.struct("date", "list_id")
    picked = (
        baskets.where("member").groupBy("actor").agg(F.min(ends).alias("one"), F.max(ends).alias("two"))
    )
    versions = picked.select(
        F.col("actor").alias("owner"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("version"), F.col("one.list_id").alias("list_id")),
                F.struct(
                    F.lit(2).alias("version"),
                    F.when(F.col("two.list_id") != F.col("one.list_id"), F.col("two.list_id")).alias("list_id"),
                ),
            )
        ),
    ).where("list_id IS NOT NULL")
    held = versions.join(items.where("member").select("list_id", "item", "qty_a", "qty_b"), "list_id")
    stand = F.struct("qty_a", "qty_b")
    both = held.groupBy("owner", "item").agg(
        F.max(F.when(F.col("version") == 1, stand)).alias("one"),
        F.max(F.when(F.col("version") == 2, stand)).alias("two"),
    )
    moved = versions.where("version = 2").select("owner", F.lit(True).alias("moved"))
    none = F.struct(F.lit(0).alias("qty_a"), F.lit(0).alias("qty_b"))
    laid = (
        both.join(moved, "owner", "left")
        .select(
            "owner", "item",
            F.inline(
                F.array(
                    F.struct(F.lit(1).alias("version"), F.col("one").alias("at")),
                    F.struct(
                        F.lit(2).alias("version"),
                        F.when(F.col("two").isNotNull(), F.col("two")).when(F.col("moved"), none).alias("at"),
                    ),
                )
            ),
        )
        .where("at IS NOT NULL")
        .select("owner", "version", "item", "at.qty_a", "at.qty_b")
    )
    copies = F.col("qty_a") + F.col("qty_b")
    override = F.when(copies >= 3, F.lit("flex")).when(
        (F.col("item") == cfg.divergence_item) & (F.col("qty_a") > 0), F.lit("core")
    )
    note = F.when(copies == 0, F.lit("cut")).when(
        (F.col("qty_a") > 0) & (F.col("qty_b") > 0), F.lit("split over the boards")
    )
    return laid.withColumn("override", override).withColumn("note", note)


def tracked_subjects(part: DataFrame) -> DataFrame:
    """Questions drawn from the part table: each type asks about its own item and
    the list total while the mirror stands, each brand about its item and names."""
    none = F.lit(None).cast("string")
    rows = F.array(
        *[
            F.struct(h.alias("hypothesis_id"), s.alias("subject"), c.alias("conditional_on"))
            for h, s, c in (
                (F.col("p_type"), F.concat(F.lit("type:"), "p_type"), F.lit(subjects.MIRROR)),
                (F.col("p_type"), F.lit(subjects.TOTAL_SUBJECT), F.lit(subjects.MIRROR)),
                (F.col("p_brand"), F.concat(F.lit("brand:"), "p_brand"), none),
                (F.col("p_brand"), F.concat(F.lit("name:"), "p_name"), none),
            )
        ]
    )
    return part.select(F.inline(rows)).distinct()


def asked_configurations(items: DataFrame) -> DataFrame:
    """Every configuration the cohort registered any item at."""
    return (
        items.where("member")
        .select(F.col("item").alias("target"), F.col("qty_a").alias("target_a"), F.col("qty_b").alias("target_b"))
        .distinct()
    )
