"""The ledger that the next session finds: flags by buckets of their identity.

A run's detections are compared with what stands; buckets in which a flag is new or
reads otherwise are merged and written, the others keep their files. A flag that a
run doesn't raise stays as it was, so it touches no bucket either.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.ledger import LEDGER_SCHEMA, empty, identity, merge
from ..session import settled
from .versions import Pinned, Versions

TABLE, BUCKETS = "ledger", 32


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(identity()), F.lit(buckets)).cast("string")


def load(versions: Versions, number: int | None = None) -> tuple[DataFrame, Pinned]:
    """The ledger as a version has it, and the hold on that version; empty where no run has recorded any."""
    pinned = versions.open(number)
    return _read(pinned), pinned


def _read(pinned: Pinned, only: list[str] | None = None) -> DataFrame:
    return pinned.read(TABLE, only) if pinned.number else empty(pinned.home.spark)


def _readings(frame: DataFrame) -> Column:
    """All that a flag says, float sums to nine places since they add up in any order."""
    shown = [F.round(f.name, 9).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in frame.schema if f.name != "first_seen"]
    return F.struct(*shown)


def record(versions: Versions, detected: DataFrame, today, buckets: int = BUCKETS) -> int:
    """Merge a run's detections and commit the next version, or leave what stands if they say nothing new.

    The number of buckets is fixed by the first run.
    """
    spark = versions.spark
    with versions.open() as base:
        buckets = int(base.schemas.get("ledger_buckets", buckets))
        standing = _read(base)
        # Two lists of one actor in one event are one flag, so a run is merged with itself first.
        found = settled(merge(empty(spark), detected, today), "detected")
        told = standing.select(identity().alias("flag_id"), _readings(standing).alias("was"))
        news = (
            found.select(identity().alias("flag_id"), _readings(found).alias("now"), bucket_of(buckets).alias("part"))
            .join(told.hint("merge"), "flag_id", "left").where(~F.col("now").eqNullSafe(F.col("was")))
        )
        parts = sorted(row.part for row in news.select("part").distinct().collect())  # at most `buckets` rows
        if not parts and base.number:
            return base.number
        merged = merge(_read(base, parts), found.where(bucket_of(buckets).isin(parts)), today)
        written = versions.write(merged, TABLE, bucket_of(buckets), "kind", "segment", "item", "list_id")
        return versions.commit(base, {TABLE: written}, {TABLE: LEDGER_SCHEMA, "ledger_buckets": str(buckets)})
