"""The standing store: built once, then refreshed by the days that may still change.

Four tables lie under `versions`, cut by day or month: baskets, item rows, and two of
mergeable partial counts, `tallies` (a configuration's lists, finish weight and best
finish a day) and `populations` (lists and weight of a segment a day). Adoption in
any window and every sliding window are sums over the partial counts, so readings
move no fact rows, and a refresh replaces partial counts of the parts it touches.

A refresh reads what is published of the last unsettled days and of events not held
yet. Settled days of held events are not read again. What changes beyond those days
is the finish weight of settled lists whose event gained or lost its best total; the
parts of such lists are written anew as well, all others keep their files.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.frames import stacked
from ..operators import hype, ingest
from ..operators.scope import attach, finish_weights, labelled
from ..session import settled
from .store import count_items
from .versions import Pinned, Versions

GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
RAW_ITEM = ("list_id", "item", "qty_a", "qty_b")


@dataclass
class Standing:
    """One version of the store, pinned until it is closed."""

    pinned: Pinned
    cfg: EngineConfig

    @property
    def baskets(self) -> DataFrame:
        return self.pinned.read("baskets")

    @property
    def items(self) -> DataFrame:
        return self.pinned.read("items")

    @property
    def tallies(self) -> DataFrame:
        return self.pinned.read("tallies")

    @property
    def populations(self) -> DataFrame:
        return self.pinned.read("populations")

    def close(self) -> None:
        self.pinned.close()

    def __enter__(self) -> "Standing":
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the version it made, the parts it wrote, and the index rows in and out."""

    version: int
    parts: list[str]
    added: DataFrame
    withdrawn: DataFrame


def part_of(grain: str) -> Column:
    return F.date_format("date", GRAINS[grain])


def open_store(versions: Versions, cfg: EngineConfig, number: int | None = None) -> Standing:
    return Standing(versions.open(number), cfg)


def build(versions: Versions, published: DataFrame, entries: DataFrame, cfg: EngineConfig, grain: str = "day") -> int:
    """The first version, or a whole one in place of what stands.

    `published` has a row a list as `classify` takes them, `entries` the rows of their items.
    """
    with versions.open() as base:
        # Ids of all lists look small in their files and would be sent to every task; dealt, a task holds its own ids.
        listed = published.select("list_id").hint("shuffle_hash")
        counted = settled(count_items(entries.join(listed, "list_id", "left_semi"), cfg), "standing-counted")
        baskets = settled(labelled(finish_weights(published), counted, cfg), "standing-baskets")
        written = _write(versions, baskets, counted.select(*RAW_ITEM), grain)
        gone = {table: {part: None for part in base.parts(table)} for table in written[0]}
        return versions.commit(base, {table: gone[table] | parts for table, parts in written[0].items()}, written[1])


def _write(versions: Versions, baskets: DataFrame, raw_items: DataFrame, grain: str) -> tuple[dict, dict]:
    """All four tables of some whole parts, the counts taken from the item rows as written."""
    part = part_of(grain)
    items = attach(raw_items, baskets)
    parts = {"baskets": versions.write(baskets, "baskets", part, "list_id"), "items": versions.write(items, "items", part, "list_id")}
    schemas = {"baskets": _shape(baskets), "items": _shape(items)}
    held = Pinned(versions, 0, parts, schemas)
    for name, frame, spread in (
        ("tallies", hype.tally_by_day(held.read("items")), ("item", "segment")),
        ("populations", hype.population_by_day(held.read("baskets")), ("date",)),
    ):
        parts[name], schemas[name] = versions.write(frame, name, part, *spread), _shape(frame)
    return parts, schemas


def _shape(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def refresh(versions: Versions, published: DataFrame, entries: DataFrame, today, cfg: EngineConfig, grain: str = "day") -> Refreshed:
    """Bring the standing store up to what is published today."""
    end = F.lit(today).cast("date") if isinstance(today, str) else today
    with versions.open() as base:
        old = base.read("baskets")
        open_day = F.col("date") >= F.date_sub(end, cfg.unsettled_days)
        taken = settled(ingest.to_refresh(published, old, end, cfg), "standing-taken")
        events = settled(stacked(taken.select("event_id"), old.where(open_day).select("event_id")).distinct(), "standing-events")

        # Settled lists of those events stay as they are but for the weight their event gives them.
        counted = settled(count_items(entries.join(taken.select("list_id"), "list_id", "left_semi"), cfg), "standing-counted")
        fresh = labelled(taken, counted, cfg)
        # They carry the weight that they had, so no list is looked up among all that the store holds.
        stay = old.where(~open_day).join(events, "event_id", "left_semi").withColumnRenamed("weight", "was").withColumn("stood", F.lit(True))
        weighed = finish_weights(stacked(stay.select(*fresh.columns, "was", "stood"), fresh))
        rebuilt = settled(weighed.select(*old.columns, "was", "stood"), "standing-rebuilt")
        moved = rebuilt.where(F.col("stood").isNull() | ~F.col("weight").eqNullSafe(F.col("was")))

        part = part_of(grain)
        # As many rows as the calendar has parts.
        touched = stacked(moved.select(part.alias("part")), old.where(open_day).select(part.alias("part"))).distinct()
        parts = sorted(row.part for row in touched.collect())
        here = part.isin(parts)
        before = base.read("baskets", parts)
        others = before.where(~open_day).join(events, "event_id", "left_anti")
        after = settled(stacked(others, rebuilt.where(here).drop("was", "stood")), "standing-after")
        kept_items = base.read("items", parts).select(*RAW_ITEM).join(taken.select("list_id"), "list_id", "left_anti")
        tables, schemas = _write(versions, after, stacked(kept_items, counted.select(*RAW_ITEM)), grain)
        # A part that lost every list is named no more.
        changed = {table: {name: None for name in parts} | found for table, found in tables.items()}
        number = versions.commit(base, changed, base.schemas or schemas)
        one, two = settled(ingest.index_rows(after), "standing-index-after"), settled(ingest.index_rows(before), "standing-index-before")
        return Refreshed(number, parts, ingest.difference(one, two), ingest.difference(two, one))
