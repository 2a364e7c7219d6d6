"""Hype episodes: league adoption leaping behind a visible finish.

One pass reduces the fact rows to configuration and day. Every sliding window,
before, during and after a spike, is then a sum over that small table, so the
whole detector moves the facts once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, LEAGUE, EngineConfig
from ..functions.dates import is_weekend, sundays_reached
from ..functions.shares import share
from ..session import settled
from .scope import day_number, last_day, since

KEY = ("segment", "item", "qty_a", "qty_b")
ROLES = ("before", "now", "after")
PLACE_STEP = 1_000_000
# What `tally_by_day` and `population_by_day` give.
Days = tuple[DataFrame, DataFrame]


def _counts() -> list[Column]:
    challenge = F.col("stratum") == CHALLENGE
    weight = F.coalesce("weight", F.lit(0.0))
    return [
        F.count_if(F.col("stratum") == LEAGUE).alias("league"),
        F.count_if(challenge).alias("challenge"),
        F.coalesce(F.sum(F.when(challenge, weight)), F.lit(0.0)).alias("weight"),
    ]


def cohort_since_epoch(frame: DataFrame, cfg: EngineConfig) -> DataFrame:
    return since(frame, cfg.epoch_start).where("member")


def visible(cfg: EngineConfig) -> Column:
    """Whether a finish is one the field would have seen."""
    return (F.col("stratum") == CHALLENGE) & (F.col("placement") <= cfg.hype_origin_placement)


def finish_rank() -> Column:
    """Finishes in order, best placement first and then the earlier day, as one
    number: a number aggregates by hash where a struct would sort every fact."""
    return F.col("placement").cast("bigint") * PLACE_STEP + day_number()


def day_tally(items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per configuration and day since the epoch: lists by stratum, finish weight, best visible finish."""
    return seen_finishes(tally_by_day(cohort_since_epoch(items, cfg)), cfg)


def tally_by_day(items: DataFrame) -> DataFrame:
    """Per configuration of the cohort and day: lists by stratum, finish weight, best finish of all.

    Counts of a day add up with those of any other, so they are stored a day each.
    """
    ranked = F.when(F.col("stratum") == CHALLENGE, finish_rank())
    return items.where("member").groupBy(*KEY, "date").agg(*_counts(), F.min(ranked).alias("best"))


def seen_finishes(tallies: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Tallies whose best finish is one the field would have seen, or none."""
    return tallies.withColumn("best", F.when(F.col("best") < (cfg.hype_origin_placement + 1) * PLACE_STEP, F.col("best")))


def day_population(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    return cohort_since_epoch(baskets, cfg).groupBy("segment", "date").agg(*_counts())


def population_by_day(baskets: DataFrame) -> DataFrame:
    """Per segment and day the lists by stratum and their weight; lists outside the cohort are a row of their own."""
    return baskets.groupBy("member", "segment", "date").agg(*_counts())


def around_sundays(daily: DataFrame, keys: tuple[str, ...], last: Column, cfg: EngineConfig) -> DataFrame:
    """Sums over the window ending each Sunday, the one before and the one after.

    A day lies in a fixed number of such windows, so the fan-out is a constant
    of the configuration, and the sums combine before the shuffle.
    """
    span = cfg.hype_window_days
    first = F.lit(cfg.epoch_start).cast("date")
    ends = daily.withColumn("end", F.explode(sundays_reached("date", span, 2 * span - 1, first, last)))
    role = (
        F.when(F.col("date") > F.col("end"), F.lit("after"))
        .when(F.col("date") > F.date_sub("end", span), F.lit("now"))
        .otherwise(F.lit("before"))
    )
    told = ends.withColumn("role", role)
    sums = [
        F.coalesce(F.sum(F.when(F.col("role") == r, F.col(c))), F.lit(0)).alias(f"{r}_{c}")
        for r in ROLES
        for c in ("league", "challenge", "weight")
    ]
    if "best" in daily.columns:
        sums.append(F.min(F.when(F.col("role") != "after", F.col("best"))).alias("origin"))
    return told.groupBy(*keys, "end").agg(*sums)


def sliding_adoption(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Lists and adoption per configuration, stratum and window ending a Sunday."""
    return _sliding(around_with_population(items, baskets, cfg))


def sliding_from_tallies(tallies: DataFrame, populations: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The same over stored counts of days."""
    return _sliding(around_days(*_known((tallies, populations), cfg), cfg))


def _known(days: Days, cfg: EngineConfig) -> Days:
    """Stored counts of days as the windows read them: the cohort's since the epoch."""
    tallies, populations = days
    return seen_finishes(cohort_since_epoch(tallies.withColumn("member", F.lit(True)), cfg), cfg), cohort_since_epoch(populations, cfg)


def _sliding(around: DataFrame) -> DataFrame:
    read = around.where("now_league + now_challenge > 0")
    strata = F.array(
        *[
            F.struct(
                F.lit(name).alias("stratum"),
                F.col(f"now_{c}").alias("lists"),
                F.col(f"of_now_{c}").alias("population"),
            )
            for name, c in ((LEAGUE, "league"), (CHALLENGE, "challenge"))
        ]
    )
    return (
        read.select(*KEY, "end", F.inline(strata))
        .where("lists > 0")
        .withColumn("adoption", share(F.col("lists"), F.col("population")))
    )


def around_with_population(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    return around_days(day_tally(items, cfg), day_population(baskets, cfg), cfg)


def around_days(tallies: DataFrame, populations: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The windows around each Sunday with their populations, from counts of days."""
    last = last_day(populations)
    sized = around_sundays(populations, ("segment",), last, cfg)
    # A row per segment and Sunday: the calendar bounds the broadcast.
    sized = sized.select("segment", "end", *[
        F.col(f"{r}_{c}").alias(f"of_{r}_{c}") for r in ROLES for c in ("league", "challenge", "weight")
    ])
    taken = around_sundays(tallies, KEY, last, cfg)
    return taken.join(F.broadcast(sized), ["segment", "end"])


def spikes(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, days: Days | None = None) -> DataFrame:
    """Every window a configuration leapt in behind a finish, before suppression."""
    return spikes_from_tallies(*days, cfg) if days else _spikes(around_with_population(items, baskets, cfg), cfg)


def spikes_from_tallies(tallies: DataFrame, populations: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The same over stored counts of days."""
    return _spikes(around_days(*_known((tallies, populations), cfg), cfg), cfg)


def _spikes(around: DataFrame, cfg: EngineConfig) -> DataFrame:
    to = share(F.col("now_league"), F.col("of_now_league"))
    was = share(F.col("before_league"), F.col("of_before_league"))
    return (
        around
        .where(F.least("of_now_league", "of_before_league") >= cfg.hype_min_lists)
        .withColumn("from_adoption", was)
        .withColumn("to_adoption", to)
        .where((F.col("to_adoption") >= cfg.hype_ceiling) & (F.col("from_adoption") < cfg.hype_floor))
        .where(F.col("origin").isNotNull())
    )


def with_origins(found: DataFrame, items: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Spikes with the finish behind each, ties to the smaller actor and list.

    Only the few rows a spike points at are looked up among the facts.
    """
    finishes = cohort_since_epoch(items, cfg).where(visible(cfg)).select(
        *KEY, finish_rank().alias("origin"), F.struct("actor", "list_id", "event", "date", "placement").alias("finish")
    )
    first = (
        found.select(*KEY, "end", "origin")
        .join(finishes, [*KEY, "origin"])
        .groupBy(*KEY, "end")
        .agg(F.min("finish").alias("finish"))
    )
    return found.join(first, [*KEY, "end"]).select(
        *found.columns, *[F.col(f"finish.{c}").alias(f"origin_{c}") for c in ("actor", "event", "date", "placement")]
    )


def accepted(found: DataFrame, keys: tuple[str, ...], day: str, deaf_days: int) -> DataFrame:
    """Greedy suppression: after an accepted row its key is deaf for some days.

    Whether a row counts depends on which earlier rows did, so each key's rows
    are folded in day order. A key has at most one row a Sunday.
    """
    rest = [c for c in found.columns if c not in keys and c != day]
    rows = F.array_sort(F.collect_list(F.struct(day, *rest)))
    folded = F.aggregate(
        "rows",
        F.struct(F.lit(None).cast("date").alias("last"), F.slice("rows", 1, 0).alias("kept")),
        lambda state, row: F.when(
            state["last"].isNull() | (F.datediff(row[day], state["last"]) > deaf_days),
            F.struct(row[day].alias("last"), F.concat(state["kept"], F.array(row)).alias("kept")),
        ).otherwise(state),
        lambda state: state["kept"],
    )
    return found.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.inline(folded))


def maturities(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Sundays whose following window saw a challenge list on a weekend day."""
    played = cohort_since_epoch(baskets, cfg)
    weekends = (
        played.where((F.col("stratum") == CHALLENGE) & is_weekend(F.col("date"))).select("date").distinct()
    )
    first = F.lit(cfg.epoch_start).cast("date")
    ends = sundays_reached("date", cfg.hype_window_days, -1, first, last_day(played))
    return weekends.select(F.explode(ends).alias("end")).distinct().withColumn("matured", F.lit(True))


def standing(items: DataFrame, baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """League lists of each configuration over the last fresh window."""
    start = F.date_sub(last_day(cohort_since_epoch(baskets, cfg)), cfg.fresh_days - 1)
    recent = cohort_since_epoch(items, cfg).where((F.col("date") >= start) & (F.col("stratum") == LEAGUE))
    return recent.groupBy(*KEY).agg(F.count("*").alias("standing_lists"))


def standing_population(baskets: DataFrame, cfg: EngineConfig) -> DataFrame:
    start = F.date_sub(last_day(cohort_since_epoch(baskets, cfg)), cfg.fresh_days - 1)
    recent = cohort_since_epoch(baskets, cfg).where((F.col("date") >= start) & (F.col("stratum") == LEAGUE))
    return recent.groupBy("segment").agg(F.count("*").alias("standing_population"))


def _tilt(role: str) -> Column:
    raw = share(F.col(f"{role}_challenge"), F.col(f"of_{role}_challenge"))
    return share(F.col(f"{role}_weight"), F.col(f"of_{role}_weight")) - raw


def hype(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, days: Days | None = None) -> DataFrame:
    """Every episode since the epoch start, with its verdict and its standing.

    `days` are the stored counts of days of these lists, where they stand already.
    """
    kept = accepted(spikes(items, baskets, cfg, days), KEY, "end", cfg.hype_window_days)
    episodes = with_origins(settled(kept, "episodes"), items, cfg)
    read = (
        episodes.join(F.broadcast(maturities(baskets, cfg)), "end", "left")
        .join(standing(items, baskets, cfg), list(KEY), "left")
        .join(F.broadcast(standing_population(baskets, cfg)), "segment", "left")
    )
    last = last_day(cohort_since_epoch(baskets, cfg))
    before = share(F.col("now_challenge"), F.col("of_now_challenge"))
    after = share(F.col("after_challenge"), F.col("of_after_challenge"))
    matured = F.coalesce("matured", F.lit(False))
    thick = F.col("of_after_challenge") >= cfg.hype_min_lists
    held = F.coalesce(after >= before, F.lit(False)) | (after >= cfg.hype_ceiling)
    now = F.when(
        F.col("standing_population") > 0,
        F.coalesce("standing_lists", F.lit(0)) / F.col("standing_population"),
    )
    state = (
        F.when(~matured, F.lit("raised"))
        .when(~thick, F.lit("matured"))
        .when(held, F.lit("established"))
        .otherwise(F.lit("decayed"))
    )
    return read.select(
        F.lit("hype").alias("kind"), *KEY, F.col("end").alias("raised_on"),
        "from_adoption", "to_adoption", F.col("of_now_league").alias("population"),
        "origin_actor", "origin_event", "origin_date", "origin_placement",
        _tilt("now").alias("tilt"), before.alias("challenge_before"),
        state.alias("state"),
        F.when(matured, share(F.col("after_league"), F.col("of_after_league"))).alias("league_after"),
        F.when(matured & thick, after).alias("challenge_after"),
        F.when(matured & thick, _tilt("after")).alias("tilt_after"),
        F.when(matured, F.least(F.date_add("end", cfg.hype_window_days), last)).alias("resolved_on"),
        now.alias("now_adoption"),
        F.when(now < cfg.hype_floor, F.lit("lapsed")).when(now.isNotNull(), F.lit("holding")).alias("standing"),
    )
