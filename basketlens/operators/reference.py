"""Reference baskets read against the segment each belongs to.

Every reading takes a table of any number of `(owner, version)` baskets:
`reference_items(owner, version, item, qty_a, qty_b, override, note)`. A row at
no copies records an item left out on purpose and is never a slot.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHALLENGE, EngineConfig
from ..functions.frames import stacked
from ..functions.shares import segment_of, share
from .adoption import by_item
from .scope import held

BASKET = ("owner", "version")


def registered(reference: DataFrame) -> DataFrame:
    return reference.where(F.col("qty_a") + F.col("qty_b") > 0)


def owner_segments(reference: DataFrame, cfg: EngineConfig, *more: Column) -> DataFrame:
    """The segment each basket belongs to, by the rule the field is read by, and what else is asked of its rows."""
    copies = F.sum(F.when(F.col("item") == cfg.divergence_item, held(cfg)))
    return reference.groupBy(*BASKET).agg(segment_of(copies, cfg).alias("segment"), *more)


def fresh_populations(read: DataFrame, stratum: str) -> DataFrame:
    """Fresh lists per segment in one stratum; segments are enumerated, so few rows."""
    return (
        read.where(F.col("stratum") == stratum)
        .groupBy("segment")
        .agg(F.max("fresh_population").alias("population"))
        .where("population > 0")
    )


def audited(reference: DataFrame, read: DataFrame, cfg: EngineConfig, stratum: str, strict: bool, *more: Column) -> DataFrame:
    """Baskets with the segment and fresh population they answer to.

    A segment that published nothing cannot be read against. A strict reading
    fails on such a basket; a batch over many leaves it out.
    """
    placed = owner_segments(reference, cfg, *more).join(
        F.broadcast(fresh_populations(read, stratum)), "segment", "left" if strict else "inner"
    )
    if not strict:
        return placed
    refusal = F.raise_error(F.concat(F.lit(f"no fresh {stratum} lists from segment "), F.col("segment")))
    return placed.withColumn("population", F.coalesce("population", refusal.cast("bigint")))


def boundary(lists: Column, population: Column, core: Column, cfg: EngineConfig) -> Column:
    """The bar a verdict turns on, where it sits within a list or two of one."""
    bars = (
        ("core", cfg.core_adoption),
        ("consensus", cfg.consensus_adoption),
        ("supported-minority", cfg.supported_minority),
    )
    near = F.lit(None).cast("string")
    for name, bar in reversed(bars):
        close = F.abs(lists - bar * population) <= cfg.boundary_lists
        near = F.when(close, F.lit(name)).otherwise(near)
    forced = core & (share(lists, population) < cfg.core_adoption)
    return F.when(~forced, near)


def bucket(confidence: Column, note: Column, cfg: EngineConfig) -> Column:
    return (
        F.when(confidence >= cfg.consensus_adoption, F.lit("consensus"))
        .when(confidence >= cfg.supported_minority, F.lit("supported-minority"))
        .when(F.coalesce(note, F.lit("")) != "", F.lit("deliberate-deviation"))
        .otherwise(F.lit("unexamined-deviation"))
    )


def slots(
    reference: DataFrame, read: DataFrame, cfg: EngineConfig,
    stratum: str = CHALLENGE, strict: bool = False,
) -> DataFrame:
    """Every registered slot, core or flex, with what its segment did about it."""
    stood = read.where(F.col("stratum") == stratum)
    exact = stood.select("segment", "item", "qty_a", "qty_b", "fresh_lists", "fresh_tilt", "delta")
    rolled = by_item(stood).select(
        "segment", "item", "segment_playing", "lead_a", "lead_b", "lead_adoption", "lead_delta"
    )
    placed = (
        registered(reference)
        .join(audited(reference, read, cfg, stratum, strict), list(BASKET))
        .join(exact, ["segment", "item", "qty_a", "qty_b"], "left")
        .join(rolled, ["segment", "item"], "left")
    )
    lists = F.coalesce("fresh_lists", F.lit(0))
    confidence = share(lists, F.col("population"))
    core = F.when(F.col("override").isNotNull(), F.col("override") == "core").otherwise(
        confidence >= cfg.core_adoption
    )
    return placed.select(
        *BASKET, "segment", F.lit(stratum).alias("stratum"), "item", "qty_a", "qty_b", "population",
        confidence.alias("confidence"),
        lists.alias("lists"),
        boundary(lists, F.col("population"), core, cfg).alias("boundary"),
        F.col("fresh_tilt").alias("tilt"),
        "delta",
        core.alias("core"),
        F.when(~core, bucket(confidence, F.col("note"), cfg)).alias("bucket"),
        "note",
        F.lit(False).alias("missing"),
        F.coalesce("segment_playing", F.lit(0.0)).alias("segment_playing"),
        "lead_a", "lead_b", "lead_adoption",
        F.lit(None).cast("double").alias("lead_tilt"),
        "lead_delta",
    )


def _lacking(
    reference: DataFrame, read: DataFrame, cfg: EngineConfig, stratum: str, bar: float, strict: bool
) -> DataFrame:
    """Every basket with `lacks`: the items at least `bar` of its segment plays and
    it has none of, the most played first and then by name.

    Shares over a bar are few however long the vocabulary: a segment whose lists
    hold n items can have at most n / bar of them, which bounds the broadcast. A
    basket's own items ride in its row, so baskets are never laid out by item to
    be told apart.
    """
    common = by_item(read.where(F.col("stratum") == stratum)).where(F.col("segment_playing") >= bar)
    told = [c for c in common.columns if c not in ("segment", "stratum", "item", "playing_lists")]
    order = F.struct((-F.col("playing_lists")).alias("behind"), "item", "playing_lists", *told)
    common = common.groupBy("segment").agg(F.array_sort(F.collect_list(order)).alias("common"))
    holds = F.collect_set(F.when(F.col("qty_a") + F.col("qty_b") > 0, F.col("item"))).alias("holds")
    # A basket without a name or number holds nothing that could be looked up by them.
    known = F.col("owner").isNotNull() & F.col("version").isNotNull()
    has = lambda row: known & F.coalesce(F.array_contains("holds", row["item"]), F.lit(False))
    return (
        audited(reference, read, cfg, stratum, strict, holds)
        .join(F.broadcast(common), "segment")
        .select(*BASKET, "segment", F.filter("common", lambda row: ~has(row)).alias("lacks"))
    )


def missing_core(
    reference: DataFrame, read: DataFrame, cfg: EngineConfig,
    stratum: str = CHALLENGE, strict: bool = False,
) -> DataFrame:
    """Core items of its segment each basket holds no copies of, noted or not."""
    lacking = _lacking(reference, read, cfg, stratum, cfg.core_adoption, strict).select(*BASKET, "segment", F.inline("lacks"))
    reasons = reference.where((F.col("qty_a") + F.col("qty_b") == 0)).select(*BASKET, "item", "note")
    off = F.greatest(F.lit(0), F.col("population") - F.col("playing_lists"))
    return lacking.join(reasons, [*BASKET, "item"], "left").select(
        *BASKET, "segment", F.lit(stratum).alias("stratum"), "item",
        F.lit(0).alias("qty_a"), F.lit(0).alias("qty_b"), "population",
        share(off, F.col("population")).alias("confidence"),
        off.alias("lists"),
        F.lit(None).cast("string").alias("boundary"),
        F.lit(None).cast("double").alias("tilt"),
        F.lit(None).cast("double").alias("delta"),
        F.lit(False).alias("core"),
        F.lit(None).cast("string").alias("bucket"),
        "note",
        F.lit(True).alias("missing"),
        "segment_playing", "lead_a", "lead_b", "lead_adoption", "lead_tilt", "lead_delta",
    )


def playtest_queue(audit: DataFrame, lacking: DataFrame) -> DataFrame:
    """Flex slots and missing core together, least backed first; at equal backing
    a slot nothing was said about comes before a noted one."""
    noted = F.coalesce(F.col("note"), F.lit("")) != ""
    return (
        stacked(audit, lacking)
        .where(~F.col("core"))
        .withColumn("noted", noted)
        .orderBy("owner", "version", "confidence", "noted", "item")
    )


def unplayed(
    reference: DataFrame, read: DataFrame, cfg: EngineConfig, stratum: str = CHALLENGE,
    floor: float | None = None, limit: int | None = None,
) -> DataFrame:
    """Every played item each basket runs none of, ranked by how many play it, with
    how many were found. A limit keeps the first ranks, and a basket's first row
    counts what it cut off. An item written down at no copies still counts as one
    the basket runs none of."""
    bar = cfg.unplayed_floor if floor is None else floor
    lacking = _lacking(reference, read, cfg, stratum, bar, False)
    off = F.greatest(F.lit(0), F.col("population") - F.col("playing_lists"))
    beyond, shown = F.lit(0), F.col("lacks")
    if limit is not None:
        beyond = F.when(F.col("rank") == 1, F.greatest(F.lit(0), F.col("found") - limit)).otherwise(F.lit(0))
        shown = F.slice("lacks", 1, limit)
    ranked = (
        lacking.select(*BASKET, "segment", F.size("lacks").cast("long").alias("found"), F.posexplode(shown).alias("at", "row"))
        .select(*BASKET, "segment", "found", (F.col("at") + 1).alias("rank"), "row.*")
    )
    return ranked.select(
        *BASKET, "segment", F.lit(stratum).alias("stratum"), "item", "segment_playing",
        "lead_a", "lead_b", "lead_adoption", "lead_delta", "population",
        share(off, F.col("population")).alias("confidence"),
        beyond.alias("dropped"), "rank", "found",
    )


def version_steps(reference: DataFrame) -> DataFrame:
    """Each version with the one before and after it, one row per captured basket."""
    order = Window.partitionBy("owner").orderBy("version")
    return (
        reference.select(*BASKET)
        .distinct()
        .withColumn("earlier", F.lag("version").over(order))
        .withColumn("later", F.lead("version").over(order))
    )


def changes(reference: DataFrame) -> DataFrame:
    """What every version did to the one before it, item by item.

    A slot stands after the step into its version and before the step out of it,
    so it is laid on both steps and each step's two sides meet in one
    aggregation: a full outer comparison without joining the table to itself.
    """
    steps = version_steps(reference)
    stand = F.struct("qty_a", "qty_b")
    laid = (
        registered(reference)
        .join(steps, list(BASKET))
        .select(
            "owner", "item",
            F.inline(
                F.array(
                    F.struct(F.col("earlier").alias("from_version"), F.col("version").alias("to_version"),
                             F.lit(None).cast("struct<qty_a:int,qty_b:int>").alias("before"), stand.alias("after")),
                    F.struct(F.col("version").alias("from_version"), F.col("later").alias("to_version"),
                             stand.alias("before"), F.lit(None).cast("struct<qty_a:int,qty_b:int>").alias("after")),
                )
            ),
        )
        .where(F.col("from_version").isNotNull() & F.col("to_version").isNotNull())
    )
    return (
        laid.groupBy("owner", "from_version", "to_version", "item")
        .agg(F.max("before").alias("before"), F.max("after").alias("after"))
        .where(~F.col("before").eqNullSafe(F.col("after")))
        .select(
            "owner", "from_version", "to_version", "item",
            F.col("before.qty_a").alias("before_a"), F.col("before.qty_b").alias("before_b"),
            F.col("after.qty_a").alias("after_a"), F.col("after.qty_b").alias("after_b"),
        )
    )
