"""Adoption: the share of one population that registered one configuration.

A population is one segment in one stratum over one window and is never a blend.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, LEAGUE, EngineConfig
from ..functions.shares import share
from .scope import in_windows, windows

WINDOWS = ("fresh", "baseline")
PLACE = ("segment", "stratum")
CONFIGURATION = ("item", "qty_a", "qty_b")


def tally(scoped: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lists and finish weight in both windows, in one pass over the scope."""
    counts = []
    for window in WINDOWS:
        inside = F.col("fresh") if window == "fresh" else ~F.col("fresh")
        counts += [
            F.count_if(inside).alias(f"{window}_lists"),
            F.sum(F.when(inside, F.col("weight"))).alias(f"{window}_weight"),
        ]
    return scoped.groupBy(*keys).agg(*counts)


def populations(scoped_lists: DataFrame) -> DataFrame:
    sized = tally(scoped_lists, PLACE)
    return sized.select(
        *PLACE,
        *[F.col(f"{w}_lists").alias(f"{w}_population") for w in WINDOWS],
        *[F.col(f"{w}_weight").alias(f"{w}_population_weight") for w in WINDOWS],
    )


def _readings(window: str) -> list[Column]:
    """One window's reading. No population is NULL; a population none of which
    took the configuration is zero. A weighted share needs points to share out."""
    lists, population = F.col(f"{window}_lists"), F.col(f"{window}_population")
    whole = F.col(f"{window}_population_weight")
    adoption = share(lists, population)
    scored = (F.col("stratum") == CHALLENGE) & (population > 0) & (whole != 0)
    weighted = F.when(scored, F.coalesce(F.col(f"{window}_weight"), F.lit(0.0)) / whole)
    return [
        lists.alias(f"{window}_lists"),
        population.alias(f"{window}_population"),
        adoption.alias(f"{window}_adoption"),
        weighted.alias(f"{window}_weighted"),
        (weighted - adoption).alias(f"{window}_tilt"),
    ]


def adoption_table(scoped: DataFrame, sizes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adoption of whatever `keys` name, per segment and stratum, both windows.

    `sizes` holds one row per segment and stratum, both of which the
    configuration enumerates, so broadcasting it has a fixed bound.
    """
    counted = tally(scoped, (*PLACE, *keys)).join(F.broadcast(sizes), list(PLACE))
    read = counted.select(*PLACE, *keys, *_readings("fresh"), *_readings("baseline"))
    return read.withColumn("delta", F.col("fresh_adoption") - F.col("baseline_adoption"))


def adoption(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Every configuration the cohort registered, with the movement between windows."""
    read = windows(baskets, cfg)
    return adoption_table(
        in_windows(items, read), populations(in_windows(baskets, read)), CONFIGURATION
    )


def from_tallies(tallies: DataFrame, populations: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The same table as sums over stored counts of days: no fact row is read."""
    read = windows(populations, cfg)
    keys = {"of": (*PLACE, *CONFIGURATION), "size": PLACE}
    counted = _summed(in_windows(tallies.withColumn("member", F.lit(True)), read), keys["of"])
    sized = _summed(in_windows(populations, read), keys["size"]).withColumnsRenamed(
        {f"{w}_{what}": f"{w}_population{end}" for w in WINDOWS for what, end in (("lists", ""), ("weight", "_weight"))}
    )
    read = counted.join(F.broadcast(sized), list(PLACE)).select(*keys["of"], *_readings("fresh"), *_readings("baseline"))
    return read.withColumn("delta", F.col("fresh_adoption") - F.col("baseline_adoption"))


def _summed(days: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    strata = F.array(
        *[F.struct(F.lit(name).alias("stratum"), F.col(column).alias("lists"), weight.alias("weight"))
          for name, column, weight in ((LEAGUE, "league", F.lit(None).cast("double")), (CHALLENGE, "challenge", F.col("weight")))]
    )
    rows = days.select(*[c for c in days.columns if c not in ("league", "challenge", "weight")], F.inline(strata)).where("lists > 0")
    sums = []
    for window in WINDOWS:
        inside = F.col("fresh") if window == "fresh" else ~F.col("fresh")
        sums += [
            F.coalesce(F.sum(F.when(inside, F.col("lists"))), F.lit(0)).alias(f"{window}_lists"),
            F.sum(F.when(inside, F.col("weight"))).alias(f"{window}_weight"),
        ]
    return rows.groupBy(*keys).agg(*sums)


def totals(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The same reading of a list-level total: how many typed copies it runs."""
    scoped = in_windows(baskets, windows(baskets, cfg))
    return adoption_table(scoped, populations(scoped), ("typed_total",))


def by_item(read: DataFrame) -> DataFrame:
    """Configurations rolled up to items: who plays it at all, and the count the
    largest bloc went to, the smallest count winning a tie.

    Shares are summed as list counts and divided once, so no float sum decides
    a verdict that sits on a bar.
    """
    order = F.struct("fresh_lists", (-F.col("qty_a")).alias("a"), (-F.col("qty_b")).alias("b"))
    lead = F.struct(
        "qty_a", "qty_b", "fresh_lists", "fresh_adoption", "fresh_tilt", "delta"
    )
    rolled = (
        read.where(F.col("fresh_lists") > 0)
        .groupBy(*PLACE, "item")
        .agg(
            F.sum("fresh_lists").alias("playing_lists"),
            F.max("fresh_population").alias("population"),
            F.max_by(lead, order).alias("lead"),
        )
    )
    return rolled.select(
        *PLACE, "item", "playing_lists", "population",
        share(F.col("playing_lists"), F.col("population")).alias("segment_playing"),
        F.col("lead.qty_a").alias("lead_a"),
        F.col("lead.qty_b").alias("lead_b"),
        F.col("lead.fresh_adoption").alias("lead_adoption"),
        F.col("lead.fresh_tilt").alias("lead_tilt"),
        F.col("lead.delta").alias("lead_delta"),
    )
