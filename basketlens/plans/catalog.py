"""Every reading by its id, over the star schema run."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StructType

from ..config import CHALLENGE, LEAGUE
from ..functions.frames import stacked
from ..functions.shares import (
    epoch_label, finish_label, finished, resolve_alias, stratum, tilt_shown,
)
from ..operators import (
    adoption, actors, composition, departures, hype, ingest, ledger, movement, novelty, outcome,
    reference, scope, series_ops, subjects, weekly,
)
from ..session import fresh_path
from ..sources import captures, matchlogs, payload, snapshots, star, store as stores
from ..streaming import tallies
from . import derived, summary
from .star import StarRun, asked_configurations, run



def _text(column: str, kind) -> F.Column:
    """Nested values as text, so two engines compare them alike."""
    if isinstance(kind.elementType, StructType):
        parts = lambda row: F.concat_ws("|", *[row[f.name].cast("string") for f in kind.elementType])
        text = F.concat_ws(";", F.transform(column, parts))
    else:
        text = F.concat_ws(",", column)
    return F.when(F.col(column).isNotNull(), text)


def tidy(frame: DataFrame) -> DataFrame:
    """Floats to nine places, since sums meet in any order, and arrays as text."""
    shown = []
    for field in frame.schema:
        if isinstance(field.dataType, DoubleType):
            shown.append(F.round(field.name, 9).alias(field.name))
        elif isinstance(field.dataType, ArrayType):
            shown.append(_text(field.name, field.dataType).alias(field.name))
        elif isinstance(field.dataType, MapType):
            shown.append(F.to_json(field.name).alias(field.name))
        else:
            shown.append(F.col(field.name))
    return frame.select(*shown)


READINGS: dict[str, Callable[[StarRun], DataFrame]] = {}


def reading(name: str):
    def add(build: Callable[[StarRun], DataFrame]):
        READINGS[name] = build
        return build

    return add


# ---- Sources and sinks ----------------------------------------------------------

@reading("s1_event_scan")
def _(r):
    return derived.payloads(r).select(
        "site_name", F.concat(derived.feed(F.col("path")), F.lit("/"), "site_name").alias("path"),
        F.size("decklists").alias("lists"),
    )


@reading("s1_quarantine")
def _(r):
    broken = payload.quarantine(r.spark, r.landing, lines=True)
    return broken.select(
        derived.feed(F.col("path")).alias("feed"), F.regexp_extract("value", '"site_name":"([^"]+)"', 1).alias("site_name")
    )


@reading("s2_event_flatten")
def _(r):
    return payload.baskets(derived.payloads(r)).drop("list_id")


@reading("s3_finish_resolution")
def _(r):
    return payload.standings(derived.payloads(r)).select("event_id", "loginid", "placement")


@reading("s4_event_class")
def _(r):
    sites = derived.site_names(r.table("orders"))
    return sites.select("list_id", payload.event_class(F.col("site_name")).alias("event_class"))


@reading("s5_item_counts")
def _(r):
    cfg = replace(r.cfg, item_aliases=(("brand:Brand#25", "brand:Brand#24"),))
    return stores.count_items(star.item_entries(r.spark, r.sf_dir), cfg).drop("typed_a")


@reading("s6_typed_totals")
def _(r):
    return stores.typed_totals(star.item_entries(r.spark, r.sf_dir), r.cfg)


@reading("s7_store")
def _(r):
    return r.baskets.select(
        "list_id", "actor", "event", "event_id", "event_class", "date", "placement", "points", "record",
        "typed_total", "cohort", "segment",
    )


@reading("s8_item_rows")
def _(r):
    return r.items.select("list_id", "item", "qty_a", "qty_b")


@reading("s9_share_snapshots")
def _(r):
    return snapshots.shares(derived.snapshot_table(r.table("events")), r.cfg)


@reading("s10_snapshot_ingest")
def _(r):
    table = derived.snapshot_table(r.table("events")).groupBy("archetype").agg(
        F.sum(F.col("meta_pct").cast("int")).cast("string").alias("meta_pct"),
        F.sum(F.col("deck_count").cast("int")).cast("string").alias("deck_count"),
    )
    return snapshots.stamped(table, "2024-01-30", 30)


@reading("s11_index")
def _(r):
    return ingest.ordered(ingest.index_rows(r.baskets))


@reading("s12_refresh")
def _(r):
    published = r.baskets.groupBy("event_id", "date").agg(F.count("*").alias("lists"))
    held = r.baskets.where("event_class = 'league'").select("event_id")
    return ingest.to_refresh(published, held, r.last_day, r.cfg)


@reading("s12_refreshed_store")
def _(r):
    """An index that lacks one event and the last days' first class is brought up to
    a publication that dropped the last days' second class."""
    late = F.col("date") >= F.date_sub(r.last_day, r.cfg.unsettled_days)
    missed = F.col("event_id") == r.baskets.agg(F.min("event_id")).scalar()
    path = fresh_path(r.spark, "index")
    ingest.write_index(ingest.index_rows(r.baskets.where((~late & ~missed) | (late & (F.col("event_class") != "1-URGENT")))), path)
    published = ingest.index_rows(r.baskets.where(~late | (F.col("event_class") != "2-HIGH")))
    added, withdrawn = ingest.refresh(path, published, r.last_day, r.cfg)
    named = (("added", added), ("withdrawn", withdrawn), ("held", ingest.read_index(r.spark, path).select(*ingest.INDEX_COLUMNS)))
    return stacked(*[frame.withColumn("part", F.lit(name)) for name, frame in named])


@reading("s12_refreshed_tallies")
def _(r):
    """Partial counts of a standing store, after a refresh with late and withdrawn lists."""
    return r.refreshed.tallies


@reading("s12_refreshed_baskets")
def _(r):
    return r.refreshed.baskets.select("list_id", "event_id", "date", "member", "segment", "weight")


@reading("s12_refreshed_adoption")
def _(r):
    return adoption.from_tallies(r.refreshed.tallies, r.refreshed.populations, r.cfg)


@reading("s12_refreshed_sliding")
def _(r):
    return hype.sliding_from_tallies(r.refreshed.tallies, r.refreshed.populations, r.cfg)


@reading("s13_typed_items")
def _(r):
    return stores.typed_items(star.item_entries(r.spark, r.sf_dir), r.cfg)


@reading("s14_reference_captures")
def _(r):
    return captures.read(derived.capture_texts(r.reference), r.cfg)


@reading("s15_match_records")
def _(r):
    read = matchlogs.records(r.logs)
    return read.select("match_id", "players", "winner", "score")


@reading("s15_game_wins")
def _(r):
    return matchlogs.game_wins(matchlogs.events(r.logs))


@reading("s15_cards_seen")
def _(r):
    return matchlogs.cards_seen(matchlogs.events(r.logs)).select(
        "match_id", "player", "card"
    )


@reading("s16_match_sink")
def _(r):
    read = matchlogs.records(r.logs)
    path = fresh_path(r.spark, "matches")
    matchlogs.write(read, path)
    return r.spark.read.schema(read.schema).json(path).select("match_id", "players", "game_wins", "winner", "score")


@reading("s17_weekly_sink")
def _(r):
    dense = _dense(r)
    path = fresh_path(r.spark, "weekly")
    weekly.write_table(dense, path)
    order = "week date, panel string, board string, item string, avg_copies double, lists bigint, highlight boolean"
    return r.spark.read.schema(order).option("header", True).csv(path)


@reading("s18_ledger_store")
def _(r):
    return r.earlier_ledger


# ---- Projections and predicates ---------------------------------------------------

@reading("p1_cohort")
def _(r):
    return r.baskets.select("list_id", "cohort")


@reading("p2_segment")
def _(r):
    return r.baskets.where("member").select("list_id", "segment")


@reading("p3_stratum")
def _(r):
    return r.baskets.select("list_id", stratum("event_class").alias("stratum"))


@reading("p4_epoch")
def _(r):
    return r.baskets.select("list_id", epoch_label("date", r.cfg).alias("regime"))


@reading("p5_window_scope")
def _(r):
    read = scope.windows(r.baskets, r.cfg)
    return scope.in_windows(r.baskets, read).select(
        "list_id", "segment", "stratum", "weight", "typed_total",
        F.when(F.col("fresh"), F.lit("fresh")).otherwise(F.lit("baseline")).alias("window"),
    )


@reading("p6_cohort_lists")
def _(r):
    return composition.cohort_lists(r.baskets)


@reading("p7_item_configurations")
def _(r):
    return composition.item_configurations(r.items)


@reading("p8_item_pool")
def _(r):
    return r.pool


@reading("p9_near_miss")
def _(r):
    kept = composition.kept_signature(r.items, r.cfg)
    return kept.select("list_id", F.array_sort("kept").alias("kept"))


@reading("p10_near_miss_lists")
def _(r):
    return composition.near_misses(r.items, r.baskets, r.cfg)


@reading("p11_panels")
def _(r):
    return weekly.panels(weekly.challenge_lists(r.items, r.cfg), r.cfg)


@reading("p12_alias")
def _(r):
    aliases = (("brand:Brand#25", "brand:Brand#24"),)
    return r.items.select("item", resolve_alias(F.col("item"), aliases).alias("resolved")).distinct()


@reading("p13_arm_rows")
def _(r):
    rows = r.items.where(F.col("member"))
    return outcome.list_arms(rows).groupBy("item", "arm").agg(F.count("*").alias("rows"))


@reading("p14_tilt_floor")
def _(r):
    return r.adoption.select(
        "segment", "stratum", "item", "qty_a", "qty_b", tilt_shown("fresh_tilt", r.cfg).alias("tilt_shown")
    )


@reading("p15_finished")
def _(r):
    return r.baskets.select("list_id", finished(r.cfg).alias("finished"))


@reading("p16_finish_label")
def _(r):
    return r.baskets.select("list_id", finish_label().alias("finish"))


# ---- Joins ---------------------------------------------------------------------------

@reading("j1_items_lists")
def _(r):
    left = r.items.select("list_id", "item", "qty_a", "qty_b")
    right = r.baskets.where("member").select("list_id", "actor", "date", "segment")
    return left.join(right, "list_id")


def _diff(r):
    before = ingest.index_rows(r.baskets.join(derived.with_status(r, "F", "P"), "list_id", "left_semi"))
    after = ingest.index_rows(r.baskets.join(derived.with_status(r, "O", "P"), "list_id", "left_semi"))
    return ingest.difference(after, before), ingest.difference(before, after)


@reading("j2_arrivals")
def _(r):
    return ingest.arrivals(_diff(r)[0], r.baskets)


@reading("j3_share_as_of")
def _(r):
    days = r.table("events").select(F.to_date("ts").alias("day"))
    return composition.share_as_of(days, r.snapshots, r.cfg.share_cohort, r.cfg.share_window_days)


@reading("j4_series")
def _(r):
    return composition.series(r.items, r.baskets, r.cfg.epoch_start)


@reading("j5_near_miss_series")
def _(r):
    return composition.series(r.items, r.baskets, r.cfg.epoch_start, near_miss=True)


@reading("j6_arm_flags")
def _(r):
    return outcome.list_arms(outcome.scope(r.items, r.cfg))


@reading("j7_lineage_spread")
def _(r):
    return ledger.lineage(r.ledger).where("spread_item IS NOT NULL").select(
        "segment", "actor", "event", "date", "spread_item", "spiked_on", "resolved", "standing"
    )


@reading("j8_followers")
def _(r):
    return departures.follower_names(r.items, r.baskets, r.breakthroughs, r.cfg)


@reading("j9_slot_adoption")
def _(r):
    return reference.slots(r.reference, r.adoption, r.cfg).select(
        "owner", "version", "segment", "item", "qty_a", "qty_b", "population", "lists", "confidence",
        "segment_playing", "lead_a", "lead_b", "lead_adoption", "lead_delta",
    )


@reading("j10_missing_core")
def _(r):
    return reference.missing_core(r.reference, r.adoption, r.cfg)


@reading("j11_unplayed")
def _(r):
    return reference.unplayed(r.reference, r.adoption, r.cfg)


@reading("j12_changes")
def _(r):
    return reference.changes(r.reference)


@reading("j13_history")
def _(r):
    return reference.changes(r.reference).groupBy("owner", "from_version", "to_version").agg(
        F.count("*").alias("changed")
    )


@reading("j14_subject_readings")
def _(r):
    return subjects.readings(r.subjects, r.adoption, r.totals)


@reading("j15_quiet_subjects")
def _(r):
    return subjects.quiet(r.subjects, subjects.readings(r.subjects, r.adoption, r.totals), r.pool, r.cfg)


@reading("j16_subject_flags")
def _(r):
    return subjects.flagged(r.subjects, r.ledger)


def _dense(r):
    weeks = weekly.panel_weeks(r.binned)
    return weekly.densify(r.weekly_averages, weeks, weekly.movers(r.weekly_averages, weeks, r.cfg))


@reading("j17_densify")
def _(r):
    return _dense(r)


# ---- Aggregations -----------------------------------------------------------------

@reading("a1_windows")
def _(r):
    return scope.windows(r.baskets, r.cfg)


@reading("a2_populations")
def _(r):
    return adoption.populations(scope.in_windows(r.baskets, scope.windows(r.baskets, r.cfg)))


@reading("a3_adoption")
def _(r):
    return adoption.adoption(r.items, r.baskets, r.cfg)


@reading("a4_totals")
def _(r):
    return adoption.totals(r.baskets, r.cfg)


@reading("a5_conversion_gap")
def _(r):
    return composition.conversion_gap(r.baskets, r.cfg)


@reading("a6_cap_effect")
def _(r):
    return composition.conversion_gap(r.baskets, r.cfg).select("regime", "segment", "cap_effect")


@reading("a7_segment_ratio")
def _(r):
    return composition.segment_ratio(r.baskets)


@reading("a8_sliding_adoption")
def _(r):
    return hype.sliding_adoption(r.items, r.baskets, r.cfg)


@reading("a9_share_trend")
def _(r):
    return composition.share_trend(r.snapshots, r.cfg.share_cohort, r.cfg.share_window_days)


@reading("a10_item_rollup")
def _(r):
    return adoption.by_item(r.adoption)


@reading("a11_migration")
def _(r):
    return movement.migration(r.adoption, r.cfg)


@reading("a12_migrations")
def _(r):
    return movement.migrations(r.adoption, r.cfg)


@reading("a13_substitution")
def _(r):
    return movement.substitution(r.items, r.baskets, asked_configurations(r.items), r.cfg)


@reading("x1_pair_crosstab")
def _(r):
    return movement.pair_crosstab(r.items, r.baskets, r.cfg)


@reading("a14_climbing")
def _(r):
    return movement.climbing(r.adoption, r.fringe)


@reading("a15_proven_actors")
def _(r):
    return actors.proven_actors(r.baskets, r.cfg)


@reading("a16_contrast")
def _(r):
    return r.contrasts.select(
        "segment", "item", "arm", "with_lists", "with_made", "with_rate", "without_lists", "without_made",
        "without_rate", "difference", "p", "floor", "state",
    )


@reading("a17_fisher")
def _(r):
    return r.contrasts.select("segment", "item", "arm", "p")


@reading("a18_detection_floor")
def _(r):
    return r.contrasts.select("segment", "item", "arm", "floor")


@reading("a19_conversion")
def _(r):
    return r.contrasts.select(
        "segment", "item", "arm", "league_actors", "challenge_actors", "league_share", "challenge_share",
        "gap", "uncapped", "cap_effect",
    )


@reading("a20_weekly_averages")
def _(r):
    return r.weekly_averages


@reading("a21_movers")
def _(r):
    return weekly.movers(r.weekly_averages, weekly.panel_weeks(r.binned), r.cfg)


@reading("a22_dropped_lists")
def _(r):
    return weekly.dropped_lists(r.binned)


@reading("a23_match_record")
def _(r):
    read = matchlogs.records(r.logs)
    return matchlogs.match_record(read, "user")


@reading("a24_follower_bar")
def _(r):
    return departures.follower_bar(r.baskets, r.departures, r.cfg)


@reading("a25_ingest_summary")
def _(r):
    added, withdrawn = _diff(r)
    return ingest.summary(added, withdrawn, ingest.arrivals(added, r.baskets))


# ---- Windows, top-k, set operations ------------------------------------------------

@reading("w1_finish_weight")
def _(r):
    return scope.finish_weights(r.baskets.drop("weight")).select("list_id", "event_id", "weight")


@reading("w2_day_share")
def _(r):
    return composition.segment_ratio(r.baskets).select("date", "stratum", "segment", "share")


@reading("w3_novelty")
def _(r):
    return novelty.novelty(r.items, r.baskets, r.cfg)


@reading("w4_first_appearance")
def _(r):
    return r.fringe.select("segment", "item", "appeared_on", "actor")


@reading("w5_origin_finish")
def _(r):
    found = hype.spikes(r.items, r.baskets, r.cfg).select(*hype.KEY, "end", "origin")
    return hype.with_origins(found, r.items, r.cfg).drop("origin", "origin_event")


@reading("w6_episodes")
def _(r):
    found = hype.spikes(r.items, r.baskets, r.cfg).select(*hype.KEY, "end", "to_adoption")
    return hype.accepted(found, hype.KEY, "end", r.cfg.hype_window_days)


@reading("w6_refreshed_episodes")
def _(r):
    """Episodes of the refreshed standing store: folded before the refresh, and then on from the first part that it wrote."""
    return r.refreshed_episodes.select(*hype.KEY, "end", "to_adoption")


@reading("w7_as_of_tally")
def _(r):
    facts = departures.read_against(novelty.history(r.items, r.cfg.epoch_start), r.cfg)
    return departures.item_tally(facts).select("against", "stratum", "item", "date", "plays", "plays_before")


@reading("w8_debuts")
def _(r):
    return actors.debuts(novelty.history(r.baskets, r.cfg.history_start))


@reading("w9_cut_count")
def _(r):
    return reference.unplayed(r.reference, r.adoption, r.cfg, floor=0.1, limit=3).select(
        "owner", "version", "item", "rank", "dropped"
    )


@reading("t1_playtest_queue")
def _(r):
    audit = reference.slots(r.reference, r.adoption, r.cfg)
    return reference.playtest_queue(audit, reference.missing_core(r.reference, r.adoption, r.cfg))


@reading("t2_unplayed_top")
def _(r):
    return reference.unplayed(r.reference, r.adoption, r.cfg, limit=r.cfg.unplayed_limit).select(
        "owner", "version", "rank", "item", "segment_playing", "dropped"
    )


@reading("t3_substitution_ends")
def _(r):
    read = movement.substitution(r.items, r.baskets, asked_configurations(r.items), r.cfg)
    return series_ops.both_ends(read)


@reading("t3_nearest_ends")
def _(r):
    return movement.substitution_ends(r.items, r.baskets, asked_configurations(r.items), r.cfg, 3)


@reading("t4_named_arrivals")
def _(r):
    return ingest.named_arrivals(ingest.arrivals(_diff(r)[0], r.baskets))


@reading("t5_day_order")
def _(r):
    return series_ops.day_order(r.baskets.where("member"))


@reading("d9_index_difference")
def _(r):
    added, withdrawn = _diff(r)
    return stacked(added.withColumn("change", F.lit("added")), withdrawn.withColumn("change", F.lit("withdrawn")))


@reading("u1_flag_union")
def _(r):
    found = ledger.unified([r.hype, r.fringe, r.pets, r.breakthroughs])
    return found.groupBy("kind", "segment").agg(F.count("*").alias("flags"))


@reading("u2_history")
def _(r):
    return novelty.history(r.baskets, r.cfg.history_start).select("list_id", "actor", "date", "member", "segment")


@reading("u3_distincts")
def _(r):
    weeks = weekly.panel_weeks(r.binned).select(F.lit("week").alias("what"), F.col("week").cast("string").alias("value"))
    pool = r.pool.select(F.lit("item").alias("what"), F.col("item").alias("value"))
    return stacked(weeks, pool).distinct()


# ---- Detectors ----------------------------------------------------------------------

@reading("d1_hype")
def _(r):
    return r.hype


@reading("d1b_maturity")
def _(r):
    return hype.maturities(r.baskets, r.cfg).select("end")


@reading("d1c_resolution")
def _(r):
    return r.hype.select(*hype.KEY, "raised_on", "state", "league_after", "challenge_after", "tilt_after", "resolved_on")


@reading("d1d_standing")
def _(r):
    return r.hype.select(*hype.KEY, "raised_on", "now_adoption", "standing")


@reading("d2_fringe")
def _(r):
    return r.fringe


@reading("d3_pet_items")
def _(r):
    return r.pets


@reading("d4_departure")
def _(r):
    return r.candidates.select("list_id", "against", "delta", "novel", "missing")


@reading("d5_segment_choice")
def _(r):
    return r.candidates.where("NOT own").select("list_id", "against", "delta")


@reading("d6_mode")
def _(r):
    return r.departures.select("list_id", "mode")


@reading("d7_breakthroughs")
def _(r):
    return r.breakthroughs


@reading("d8_follow_through")
def _(r):
    return r.breakthroughs.select("list_id", "state", "followers", "adopted_item", "needed")


@reading("m1_ledger")
def _(r):
    return r.ledger


@reading("m2_lineage")
def _(r):
    return ledger.lineage(r.ledger)


@reading("r1_slot_audit")
def _(r):
    return reference.slots(r.reference, r.adoption, r.cfg)


@reading("r2_clocks")
def _(r):
    return ledger.clocks(r.ledger, r.cfg)


@reading("r3_dossier")
def _(r):
    return summary.dossier(r.adoption, r.ledger, r.contrasts, r.cfg)


def _section(name):
    return lambda r: summary.sections(r)[name]()


for _name in ("windows", "audit", "audit_counts", "unplayed", "climbing", "near_misses", "hype", "lineage", "trend"):
    READINGS[f"r4_{_name}"] = _section(_name)


@reading("r4_ratio")
def _(r):
    part = lambda row: F.concat_ws("|", row["segment"], row["lists"].cast("string"))
    return summary.ratio_rows(r.baskets, r.cfg).select(
        "date", "stratum", F.transform("split", part).alias("split")
    )


for _name in ("readings", "quiet", "flags", "mirror"):
    READINGS[f"r5_{_name}"] = (lambda part: lambda r: r.evidence[part])(_name)


# ---- Streaming --------------------------------------------------------------------

@reading("st1_arrivals")
def _(r):
    return derived.streamed_arrivals(r)


@reading("st2_sliding_tally")
def _(r):
    events = tallies.stream_events(r.spark, r.sf_dir)
    return tallies.run_to_end(tallies.sliding(events, ["event_type"], r.cfg), ["event_type"], "sliding-tally")


@reading("st2_closed_windows")
def _(r):
    """Windows that have closed, with what came too late for them; the rest is open still."""
    events = tallies.stream_events(r.spark, r.sf_dir)
    done = tallies.run_closed(events, ["event_type"], r.cfg, fresh_path(r.spark, "closed-tally"))
    return stacked(done.windows.withColumn("late", F.lit(False)), done.late.withColumn("late", F.lit(True)))


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(READINGS[name](run(spark, sf_dir)))
