"""Whether lists on a configuration finished differently from lists without it.

One reading for every arm of every item at once: the item at any count, on
either board, and at each exact configuration. The half without an arm is the
segment's total less the half with it, so lists are never joined to arms.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHALLENGE, LEAGUE, EngineConfig
from ..functions.exact import detection_floor, fisher
from ..functions.frames import stacked
from ..functions.shares import cap_effect, share
from .hype import cohort_since_epoch

ARM = ("segment", "item", "arm")
STRATA = (("league", LEAGUE), ("challenge", CHALLENGE))
COUNTS = ("league_lists", "challenge_lists", "ranked", "made")


def arm_match(item: str, qty_a: int | None = None, qty_b: int | None = None, board: str | None = None) -> Column:
    """Whether an item row puts its list in the arm: the item at any count, on
    one board, or at one configuration."""
    same = F.col("item") == item
    if board:
        return same & (F.col(f"qty_{board}") > 0)
    if qty_a is None and qty_b is None:
        return same
    return same & (F.col("qty_a") == (qty_a or 0)) & (F.col("qty_b") == (qty_b or 0))


def arm_names() -> Column:
    """Every arm an item row belongs to, by name; at most four."""
    on_a = F.when(F.col("qty_a") > 0, F.lit("board a"))
    on_b = F.when(F.col("qty_b") > 0, F.lit("board b"))
    return F.array_compact(
        F.array(F.lit("any count"), on_a, on_b, F.concat_ws("/", "qty_a", "qty_b"))
    )


def list_arms(items: DataFrame) -> DataFrame:
    """Every arm each list is in, of every item it holds; a list without a row
    for an arm is outside it."""
    return items.select(
        "list_id", "segment", "stratum", "actor", "placement", "item", F.explode(arm_names()).alias("arm")
    )


def _tallies(cfg: EngineConfig) -> list[Column]:
    challenge = F.col("stratum") == CHALLENGE
    made = challenge & (F.col("placement") <= cfg.proven_placement)
    return [
        *[F.count_if(F.col("stratum") == name).alias(f"{side}_lists") for side, name in STRATA],
        F.count_if(challenge & F.col("placement").isNotNull()).alias("ranked"),
        F.count_if(made).alias("made"),
    ]


def _by_actor(frame: DataFrame, keys: tuple[str, ...], cfg: EngineConfig) -> DataFrame:
    """List counts, and actors counted once, per key. Actors are reduced to one
    row each before they are counted, so a busy key splits over its actors."""
    return _of_actors(frame.groupBy(*keys, "actor").agg(*_tallies(cfg)), keys)


def _of_actors(per_actor: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return per_actor.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.count_if(F.col(f"{side}_lists") > 0).alias(f"{side}_actors") for side, _ in STRATA],
    )


def _armed(facts: DataFrame) -> DataFrame:
    """A row per arm and actor, of tallies by configuration and actor.

    A configuration's own arm is such a tally already. The arms that configurations
    share are summed side by side in one row an item and actor and laid out after
    that, so what is dealt and held by key is never a multiple of the tallies.
    """
    own = facts.select(*ARM[:2], F.concat_ws("/", "qty_a", "qty_b").alias("arm"), "actor", *COUNTS)
    inside = {"any count": F.lit(True), "board a": F.col("qty_a") > 0, "board b": F.col("qty_b") > 0}
    side_by_side = [
        F.struct(
            F.lit(arm).alias("arm"), F.max(held).alias("held"),
            *[F.coalesce(F.sum(F.when(held, F.col(c))), F.lit(0)).alias(c) for c in COUNTS],
        )
        for arm, held in inside.items()
    ]
    shared = facts.groupBy(*ARM[:2], "actor").agg(F.array(*side_by_side).alias("arms")).select(*ARM[:2], "actor", F.inline("arms"))
    return stacked(own, shared.where("held").drop("held"))


def scope(frame: DataFrame, cfg: EngineConfig, until: str | None = None) -> DataFrame:
    found = cohort_since_epoch(frame, cfg)
    return found.where(F.col("date") <= F.lit(until).cast("date")) if until else found


def contrasts(items: DataFrame, baskets: DataFrame, cfg: EngineConfig, until: str | None = None) -> DataFrame:
    """The outcome contrast and league conversion of every arm, per segment."""
    counts = (*COUNTS, "league_actors", "challenge_actors")
    # One row a segment, which the configuration enumerates.
    whole = _by_actor(scope(baskets, cfg, until), ("segment",), cfg).select(
        "segment", *[F.col(c).alias(f"all_{c}") for c in counts]
    )
    # Facts are tallied by configuration first; only tallies are laid out by arm.
    facts = scope(items, cfg, until).groupBy("segment", "item", "qty_a", "qty_b", "actor").agg(*_tallies(cfg))
    read = _of_actors(_armed(facts), ARM).join(F.broadcast(whole), "segment")
    tables = read.select(
        *ARM,
        F.col("ranked").alias("with_lists"), F.col("made").alias("with_made"),
        (F.col("all_ranked") - F.col("ranked")).alias("without_lists"),
        (F.col("all_made") - F.col("made")).alias("without_made"),
        share(F.col("all_made"), F.col("all_ranked")).alias("pooled"),
        *[F.col(f"{side}_actors").alias(f"{side}_actors") for side, _ in STRATA],
        *[share(F.col(f"{side}_actors"), F.col(f"all_{side}_actors")).alias(f"{side}_share") for side, _ in STRATA],
        *[share(F.col(f"{side}_lists"), F.col(f"all_{side}_lists")).alias(f"{side}_uncapped") for side, _ in STRATA],
    )
    with_rate = share(F.col("with_made"), F.col("with_lists"))
    without_rate = share(F.col("without_made"), F.col("without_lists"))
    p = fisher(
        F.col("with_made"), F.col("with_lists") - F.col("with_made"),
        F.col("without_made"), F.col("without_lists") - F.col("without_made"),
    )
    return (
        tables.withColumn("p", p)
        .withColumn("gap", F.col("league_share") - F.col("challenge_share"))
        .withColumn("uncapped", F.col("league_uncapped") - F.col("challenge_uncapped"))
        .select(
            *ARM, "with_lists", "with_made", with_rate.alias("with_rate"),
            "without_lists", "without_made", without_rate.alias("without_rate"),
            (with_rate - without_rate).alias("difference"),
            "p",
            detection_floor(F.col("pooled"), F.col("with_lists"), F.col("without_lists"), cfg.power_z).alias("floor"),
            F.when(F.col("p") < cfg.alpha, F.lit("separates")).otherwise(F.lit("undetectable")).alias("state"),
            "league_actors", "challenge_actors", "league_share", "challenge_share",
            "gap", "uncapped", cap_effect("gap", "uncapped", cfg).alias("cap_effect"),
        )
    )
