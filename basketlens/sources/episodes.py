"""Hype episodes that stand between runs: a new week folds on, the history isn't folded again.

A configuration is deaf for some days after an accepted leap, so whether a leap counts
depends on the last accepted one alone, and only if that lies within those days. The
accepted leaps are therefore all the state the fold needs. A run begins at the first
day that may read otherwise: it reads the counts of days of the windows from there on
and the accepted leaps of the deaf days before, and replaces what was accepted since.
Months before that day keep their files.
"""

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.frames import stacked
from ..operators.hype import KEY, accepted, cohort_since_epoch, spikes_from_tallies
from .versions import Versions

TABLE, REACH = "episodes", "episodes_reach"
LEAP = (*KEY, "end", "from_adoption", "to_adoption", "origin")
MONTH = "yyyy-MM"


def advance(versions: Versions, tallies: DataFrame, populations: DataFrame, parts: list[str], cfg: EngineConfig) -> int:
    """Bring the accepted leaps up to the counts of days of a standing store, and commit the next version.

    `parts` are the days (or months) of the store that were written since the last run; the first run folds all.
    """
    span = cfg.hype_window_days
    last = cohort_since_epoch(populations, cfg).agg(F.max("date")).first()[0]
    with versions.open() as base:
        start = _first_open_day(base.schemas.get(REACH), parts) if base.number else None
        if start:
            # A leap reads its own window and the one before it.
            windows = F.col("date") > F.lit(start - timedelta(days=2 * span))
            tallies, populations = tallies.where(windows), populations.where(windows)
        leaps = spikes_from_tallies(tallies, populations, cfg).select(*LEAP)
        if start:
            deaf = base.read(TABLE, _months(start - timedelta(days=span), start)).select(*LEAP)
            earlier = deaf.where((F.col("end") < F.lit(start)) & (F.col("end") >= F.lit(start - timedelta(days=span))))
            leaps = stacked(earlier, leaps.where(F.col("end") >= F.lit(start)))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaps.schema)
        kept = accepted(leaps, KEY, "end", span).select(*LEAP)
        gone = {}
        if start:
            month = _months(start, start)
            stay = base.read(TABLE, month).select(*LEAP).where(F.col("end") < F.lit(start))
            kept = stacked(stay, kept.where(F.col("end") >= F.lit(start)))
            gone = {name: None for name in base.parts(TABLE) if name >= month[0]}
        written = versions.write(kept, TABLE, F.date_format("end", MONTH), "end", "item")
        return versions.commit(base, {TABLE: gone | written}, {TABLE: shape, REACH: last.isoformat() if last else ""})


def _first_open_day(reach: str | None, parts: list[str]) -> date | None:
    """The first day from which leaps may differ: of the parts written, or the one after the last day folded."""
    days = [date.fromisoformat(f"{part}-01"[:10]) for part in parts]
    if not reach:
        return None
    return min([*days, date.fromisoformat(reach) + timedelta(days=1)])


def _months(first: date, last: date) -> list[str]:
    months = (last.year - first.year) * 12 + last.month - first.month
    return [f"{first.year + (first.month - 1 + k) // 12}-{(first.month - 1 + k) % 12 + 1:02d}" for k in range(months + 1)]


def load(versions: Versions) -> DataFrame:
    """The accepted leaps as they stand."""
    with versions.open() as pinned:
        return pinned.read(TABLE).select(*LEAP)
