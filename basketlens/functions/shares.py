"""Column builders for shares, verdicts and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHALLENGE, LEAGUE, EngineConfig


def share(part, whole) -> Column:
    """A share of a population, NULL where there is no population."""
    return F.try_divide(part, whole)


def stratum(event_class) -> Column:
    return F.when(F.col(event_class) == LEAGUE, F.lit(LEAGUE)).otherwise(F.lit(CHALLENGE))


def epoch_label(day, cfg: EngineConfig) -> Column:
    post = F.col(day) >= F.lit(cfg.epoch_start).cast("date")
    return F.when(post, F.lit("post-regime")).otherwise(F.lit("pre-regime"))


def segment_of(copies: Column, cfg: EngineConfig) -> Column:
    """The segment whose band holds this many copies of the divergence item."""
    held = F.coalesce(copies, F.lit(0))
    label = F.lit(cfg.hybrid_segment)
    for name, low, high in reversed(cfg.segments):
        label = F.when(held.between(low, high), F.lit(name)).otherwise(label)
    return label


def cap_effect(gap, uncapped, cfg: EngineConfig) -> Column:
    """What counting each actor once did to a gap between two shares."""
    gap, uncapped = F.col(gap), F.col(uncapped)
    return (
        F.when(gap.isNull() | uncapped.isNull(), F.lit(None).cast("string"))
        .when(gap * uncapped < 0, F.lit("flips"))
        .when(F.abs(gap) < cfg.cap_collapse * F.abs(uncapped), F.lit("collapses"))
        .otherwise(F.lit("holds"))
    )


def tilt_shown(tilt, cfg: EngineConfig) -> Column:
    """A tilt worth showing; under the floor it is noise and shows as nothing."""
    return F.when(F.abs(F.col(tilt)) >= cfg.tilt_floor, F.col(tilt))


def finish_label(placement="placement", record="record") -> Column:
    ranked = F.concat(F.lit("#"), F.col(placement).cast("string"))
    return F.coalesce(ranked, F.nullif(F.col(record), F.lit("")), F.lit("5-0"))


def finished(cfg: EngineConfig) -> Column:
    """Whether a list did well enough for its choices to be evidence."""
    top = F.coalesce(F.col("placement") <= cfg.departure_placement, F.lit(False))
    return (F.col("stratum") == LEAGUE) | top


def direction(shift, cfg: EngineConfig) -> Column:
    shift = F.col(shift)
    return (
        F.when(shift >= cfg.board_shift, F.lit("to main"))
        .when(shift <= -cfg.board_shift, F.lit("to side"))
        .otherwise(F.lit("steady"))
    )


def resolve_alias(name: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    """A name under the one it is counted as. The alias table is configuration,
    a handful of pairs, so it travels as a literal map and needs no join."""
    if not aliases:
        return name
    pairs = F.create_map(*[F.lit(word) for pair in aliases for word in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)
