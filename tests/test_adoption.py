from dataclasses import replace

import pytest
from worlds import Entry, finals, league, store

from basketlens.config import DECKLISTS as CFG
from basketlens.operators import adoption, composition, movement, scope

FULL, PLAIN = (name for name, _, _ in CFG.segments)
# The last day, one in its fresh window, one in the baseline, one before the epoch.
LAST, BEFORE, OLD = "2026-07-18", "2026-06-27", "2026-05-02"


def rows(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    entries = [
        *finals(BEFORE, ("ada", "Gem 3", 12, 1), ("bob", "Gem 0/2", 9, 2), ("cat", "Gem 0/2", 9, 3), ("dan", "Gem 0/2", 6, 4), ("eve", "", 3, 5)),
        *finals(LAST, ("ada", "Gem 2/1", 12, 1), ("bob", "Gem 2/1", 6, 2), ("cat", "Gem 2/1", 3, 3), ("dan", "Gem 0/2", 15, 4)),
        *finals("2026-07-11", ("flo", "", 0, 2, "full"), ("gus", "", 0, 5, "full")),
        *league("2026-07-12", ("hal", "Gem 2/1"), ("hal", "Gem 2/1"), ("hal", "Gem 2/1"), ("ida", "", "mixed")),
        *league(OLD, ("jon", "Gem 7/7")),
    ]
    made = store(spark, tmp_path_factory.mktemp("adoption"), entries)
    return made, adoption.adoption(made.items, made.baskets, CFG).cache()


def test_shares_of_both_windows_and_their_delta(world):
    _, read = world
    gem = rows(read.where(f"item = 'Gem' AND segment = '{PLAIN}' AND stratum = 'challenge-class'"), "qty_a", "qty_b")
    assert set(gem) == {(2, 1), (0, 2), (3, 0)}, "the list before the epoch is in no window"
    assert (gem[2, 1].fresh_lists, gem[2, 1].fresh_population, gem[2, 1].baseline_population) == (3, 4, 5)
    assert gem[2, 1].delta == pytest.approx(3 / 4)
    assert gem[0, 2].delta == pytest.approx(1 / 4 - 3 / 5)
    assert (gem[3, 0].fresh_lists, gem[3, 0].fresh_adoption, gem[3, 0].delta) == (0, 0.0, pytest.approx(-1 / 5))


def test_weights_share_out_the_points_of_the_population(world):
    _, read = world
    gem = rows(read.where(f"item = 'Gem' AND stratum = 'challenge-class' AND segment = '{PLAIN}'"), "qty_a", "qty_b")
    assert gem[2, 1].fresh_weighted == pytest.approx(21 / 36)
    assert gem[2, 1].fresh_tilt == pytest.approx(21 / 36 - 3 / 4)


def test_leagues_and_scoreless_finals_have_no_weight(world):
    _, read = world
    for part in ("stratum = 'league'", f"segment = '{FULL}'"):
        told = read.where(part).collect()
        assert told and all(r.fresh_weighted is None and r.fresh_tilt is None for r in told)


def test_nobody_is_null_and_a_list_is_the_unit(world):
    _, read = world
    row = read.where("stratum = 'league' AND item = 'Gem'").first()
    assert (row.baseline_lists, row.baseline_population, row.baseline_adoption, row.delta) == (0, 0, None, None)
    assert row.fresh_lists == 3, "one actor's three lists are three"


def test_windows_hang_off_the_last_day_and_stop_at_the_epoch(world):
    made, _ = world
    at = scope.windows(made.baskets, CFG).first()
    assert [str(at[c]) for c in ("as_of", "fresh_start", "baseline_start", "baseline_end")] == ["2026-07-18", "2026-07-05", "2026-06-07", "2026-07-04"]
    assert str(scope.windows(made.baskets, replace(CFG, epoch_start="2026-06-20")).first().baseline_start) == "2026-06-20"
    assert all(v is None for v in scope.windows(made.baskets.where("false"), CFG).first())


def test_typed_totals_are_read_like_a_configuration(world):
    made, _ = world
    read = rows(adoption.totals(made.baskets, CFG).where(f"stratum = 'challenge-class' AND segment = '{PLAIN}'"), "typed_total")
    assert set(read) == {17} and read[17].fresh_adoption == 1.0


def test_ratio_conversion_and_near_misses(spark, tmp_path):
    lacking = Entry("2026-06-03", "modern-league-2026-06-031", "len", lacks="Psychic Frog")
    made = store(spark, tmp_path, [
        *league("2026-06-03", *[("kim", "")] * 5, ("lou", "", "full"), ("max", "", "full")), lacking,
        *finals("2026-06-03", ("kim", "", 9, 1), ("nan", "", 6, 2), ("oli", "", 6, 3), ("pam", "", 3, 4, "full"), ("quy", "", 0, 5, "mixed")),
    ])
    ratio = rows(composition.segment_ratio(made.baskets), "stratum", "segment")
    assert ratio["challenge-class", PLAIN].share == 3 / 5 and ratio["challenge-class", "hybrid"].share == 1 / 5
    gap = rows(composition.conversion_gap(made.baskets, CFG), "regime", "segment")
    row = gap["post-regime", PLAIN]
    # One of three league actors but five of seven league lists.
    assert (row.league_actors, row.challenge_actors) == (1, 3)
    assert row.gap == pytest.approx(1 / 3 - 3 / 5) and row.uncapped == pytest.approx(5 / 7 - 3 / 5)
    assert row.cap_effect == "flips" and gap["post-regime", "hybrid"].league_actors == 0
    (near,) = composition.near_misses(made.items, made.baskets, CFG).collect()
    assert (near.actor, near.dropped, near.kept) == ("len", ["Psychic Frog"], [i for i in CFG.signature if i != "Psychic Frog"])


def ten(day, holds):
    return finals(day, *[(f"t{k}", holds(k), 5, 1 + k) for k in range(10)])


def test_migration_between_boards(spark, tmp_path):
    few = lambda board: lambda k: f", Few {board}" if k < 4 else ""
    made = store(spark, tmp_path, [
        *ten(BEFORE, lambda k: "Move 0/1, Stay 2" + few("0/2")(k)),
        *ten(LAST, lambda k: ("Move 1, Stay 3" if k < 3 else "Move 1, Stay 2") + few("2")(k)),
    ])
    read = adoption.adoption(made.items, made.baskets, CFG).cache()
    moved = rows(movement.migration(read, CFG), "item")
    assert (moved["Move"].baseline_side_copies, moved["Move"].fresh_main_copies, moved["Move"].shift) == (10, 10, 1.0)
    assert (moved["Move"].direction, moved["Stay"].direction) == ("to main", "steady")
    assert [r.item for r in movement.migrations(read, CFG).collect()] == ["Move"]
    assert sorted(r.item for r in movement.migrations(read, CFG, floor=4).collect()) == ["Few", "Move"]


def test_substitution_and_climbing(spark, tmp_path):
    made = store(spark, tmp_path, [
        *ten(BEFORE, lambda k: "Old 1" + (", Up 0/1" if k < 2 else "")),
        *ten(LAST, lambda k: ("Old 1" if k < 6 else "Old 2, New 1") + (", Up 0/1" if k < 5 else "")),
    ])
    asked = spark.createDataFrame([("Old", 1, 0)], "target string, target_a int, target_b int")
    traded = rows(movement.substitution(made.items, made.baskets, asked, CFG), "item")
    new = traded["New"]
    assert (new.on_it, new.elsewhere, new.on_it_lists, new.elsewhere_lists) == (0.0, 1.0, 6, 4)
    assert max(traded.values(), key=lambda r: r.difference).item == "New"
    read = adoption.adoption(made.items, made.baskets, CFG)
    (up,) = movement.climbing(read, spark.createDataFrame([(PLAIN, "Up")], "segment string, item string")).collect()
    assert (up.item, up.lead_a, up.lead_b) == ("Up", 0, 1) and up.delta == pytest.approx(5 / 10 - 2 / 10)
