"""Written series whose verdicts follow from the rules and can be worked out by hand.

All days are of 2026. Kite, Owl and the other items are held beside the cohort's core.
"""

import random
import re
from datetime import date, timedelta
from math import comb

import pytest
from pyspark.sql import functions as F
from worlds import crowd, finals, league, store

from basketlens.config import DECKLISTS as CFG
from basketlens.functions.exact import fisher
from basketlens.operators import actors, departures, hype, ledger, novelty, outcome

PLAIN, FULL = CFG.segments[1][0], CFG.segments[0][0]

# League lists: none of ten up to 7 June, then five of ten up to Sunday 21 June, behind a second place on 6 June.
LEAP = [
    *crowd("2026-05-27", 5), *crowd("2026-06-05", 5), *crowd("2026-06-10", 4, 1), *crowd("2026-06-19", 6, 4),
    *finals("2026-06-06", ("ace", "Kite 1", 15, 2), ("bo", "", 12, 5), ("cy", "Kite 1", 6, 20)),
]
# A quarter of that window's challenge lists.
SHOWN = finals("2026-06-14", ("k1", "Kite 1", 18, 1), ("k2", "", 15, 4), ("k3", "", 9, 9), ("k4", "", 0, 18))
LATER = [*crowd("2026-06-23", 4, 2), *crowd("2026-07-02", 5, 2)]


def eight(day, on, points=(12, 9, 6, 12, 9, 6, 3, 3)):
    return finals(day, *[(f"{day}/f{k}", "Kite 1" if k < on else "", p, 1 + 4 * k) for k, p in enumerate(points)], number=3)


def episodes(spark, root, entries):
    made = store(spark, root, entries)
    return hype.hype(made.items, made.baskets, CFG).where("item = 'Kite'").orderBy("raised_on").collect()


def test_a_leap_behind_a_seen_finish_is_one_episode(spark, tmp_path):
    (row,) = episodes(spark, tmp_path, [*LEAP, *crowd("2026-06-23", 4, 2)])
    assert (str(row.raised_on), row.from_adoption, row.to_adoption, row.population) == ("2026-06-21", 0.0, 0.5, 10)
    assert (row.origin_actor, row.origin_placement, str(row.origin_date)) == ("ace", 2, "2026-06-06")
    assert (row.state, row.tilt, row.challenge_after, row.resolved_on) == ("raised", None, None, None)


def test_a_leap_without_a_seen_finish_is_none(spark, tmp_path):
    unseen = [e for e in LEAP if e.who not in ("ace", "bo")]
    assert episodes(spark, tmp_path, [*unseen, *crowd("2026-06-23", 4, 2)]) == []


def test_a_week_counts_once_its_sunday_is_in(spark, tmp_path):
    assert episodes(spark, tmp_path / "saturday", [*LEAP, *crowd("2026-06-20", 3, 1, number=2)]) == []
    (row,) = episodes(spark, tmp_path / "sunday", [*LEAP, *crowd("2026-06-21", 3, 1, number=2)])
    assert row.to_adoption == pytest.approx(6 / 13)


@pytest.mark.parametrize(
    "after, state, challenge_after, tilt_after",
    [
        (eight("2026-06-27", 3), "established", 3 / 8, 27 / 60 - 3 / 8),
        (eight("2026-06-28", 1), "decayed", 1 / 8, 12 / 60 - 1 / 8),
        (finals("2026-06-27", ("u", "Kite 1", 9, 1), ("v", "", 6, 2)), "matured", None, None),
        (eight("2026-06-30", 3), "raised", None, None),
    ],
)
def test_the_weekend_after_decides(spark, tmp_path, after, state, challenge_after, tilt_after):
    (row,) = episodes(spark, tmp_path, [*LEAP, *SHOWN, *LATER, *after])
    assert row.state == state and row.challenge_before == 1 / 4
    assert row.tilt == pytest.approx(18 / 42 - 1 / 4)
    assert row.challenge_after == challenge_after
    assert row.tilt_after == (None if tilt_after is None else pytest.approx(tilt_after))
    if state != "raised":
        assert str(row.resolved_on) == "2026-07-02" and row.league_after == pytest.approx(4 / 9)


def test_an_equal_share_holds_and_a_later_absence_lapses(spark, tmp_path):
    (row,) = episodes(spark, tmp_path, [*LEAP, *SHOWN, *LATER, *eight("2026-06-27", 2), *crowd("2026-08-01", 9)])
    assert (row.state, row.challenge_after) == ("established", 1 / 4)
    assert (row.now_adoption, row.standing) == (0.0, "lapsed")


def test_a_key_is_deaf_for_a_while_after_an_accepted_row(spark):
    first = date(2026, 5, 31)
    rows = [("k", first + timedelta(days=d), d) for d in (0, 7, 14, 21, 28, 50)]
    found = spark.createDataFrame(rows, "key string, end date, n int")
    assert [r.n for r in hype.accepted(found, ("key",), "end", 14).orderBy("end").collect()] == [0, 21, 50]


def test_fringe_items_new_and_back(spark, tmp_path):
    made = store(spark, tmp_path, [
        *crowd("2026-04-10", 6, 3, "Owl 1"), *crowd("2026-04-20", 6, 2, "Owl 1"), *crowd("2026-05-20", 10), *crowd("2026-06-10", 8),
        *crowd("2026-06-20", 6, 2, "Owl 1"), *crowd("2026-06-24", 5, 1, "Ibis 0/1"),
    ])
    found = {r.item: r for r in novelty.fringe_flags(made.items, made.baskets, CFG).collect()}
    assert set(found) == {"Owl", "Ibis"}
    owl, ibis = found["Owl"], found["Ibis"]
    assert (str(owl.appeared_on), owl.returning, owl.absent_days) == ("2026-06-20", True, 61)
    assert owl.historical_adoption == pytest.approx(5 / 30)
    assert (str(ibis.appeared_on), ibis.qty_a, ibis.qty_b, ibis.historical_adoption, ibis.returning) == ("2026-06-24", 0, 1, 0.0, False)


def test_only_earlier_days_make_an_item_known(spark, tmp_path):
    made = store(spark, tmp_path, [*crowd("2026-05-20", 6), *crowd("2026-06-10", 6), *crowd("2026-06-18", 5, 4, "Elk 1"), *crowd("2026-06-25", 5, 4, "Elk 1")])
    (flag,) = novelty.fringe_flags(made.items, made.baskets, CFG).collect()
    assert (flag.item, str(flag.appeared_on), flag.historical_adoption) == ("Elk", "2026-06-18", 0.0)


def test_pet_items_and_the_proven_who_stand_by_them(spark, tmp_path):
    made = store(spark, tmp_path, [
        *finals("2026-05-24", ("vet", "Fox 1, Ram 2", 15, 5), ("ann", "Hen 1", 12, 9), ("mid", "Cat 0/1", 6, 21), ("mix", "Rat 1", 9, 7, "mixed")),
        *finals("2026-05-31", ("vet", "Fox 1", 12, 11), ("ben", "Hen 1", 9, 14), ("mid", "Cat 0/1", 3, 30), ("mix", "Rat 1", 3, 22, "mixed")),
        *league("2026-06-02", ("vet", "Fox 1"), ("vet", "Ram 2"), ("mid", "Cat 0/1"), ("cid", "Hen 1"), ("mix", "Rat 1", "mixed")),
        *league("2026-06-03", ("vet", "Ram 2")),
        # After the baseline window, so they prove nobody.
        *finals("2026-07-20", ("late", "", 9, 1)), *finals("2026-07-21", ("late", "", 9, 1)),
    ])
    assert [tuple(r) for r in actors.proven_actors(made.baskets, CFG).collect()] == [("vet", 2)]
    pets = {r.item: r for r in actors.pet_items(made.items, made.baskets, CFG).collect()}
    assert set(pets) == {"Fox", "Ram", "Cat"}, "three owners of Hen are too many, and mixed lists are no segment's"
    told = {item: (p.appearances, p.actors, [tuple(d) for d in p.dissenters], p.hypothesis_candidate) for item, p in pets.items()}
    assert told == {
        "Fox": (3, ["vet"], [("vet", 2)], True),
        "Ram": (3, ["vet"], [("vet", 1)], False),
        "Cat": (3, ["mid"], [], False),
    }


BIRDS = "Auk 1, Bee 1, Cod 1, Doe 1, Eel 1"
# Ten plain lists without the birds, and ten full ones that all hold them but never finish well.
GROUND = [
    e
    for day in ("2026-05-23", "2026-05-30")
    for e in finals(day, *[(f"{day}/p{k}", "", 9, 1 + 3 * k) for k in range(5)], *[(f"{day}/f{k}", BIRDS, 3, 40 + k, "full") for k in range(5)])
]


def flags(spark, root, entries):
    made = store(spark, root, entries)
    return departures.breakthroughs(made.items, made.baskets, CFG).orderBy("date", "actor").collect()


def test_five_items_known_elsewhere_depart_from_ones_own(spark, tmp_path):
    (flag,) = flags(spark, tmp_path, [*GROUND, *finals("2026-06-13", ("hero", BIRDS, 15, 3), ("owner", BIRDS, 12, 6, "full"), ("four", BIRDS[:-7], 9, 8), ("low", BIRDS, 3, 19))])
    assert (flag.actor, flag.segment, flag["mode"], flag.delta, flag.state) == ("hero", PLAIN, "in-pool", 5, "watching")
    assert [s["item"] for s in flag.novel] == ["Auk", "Bee", "Cod", "Doe", "Eel"] and flag.missing == []


def test_lists_of_no_segment_answer_to_the_nearest_and_far_ones_to_none(spark, tmp_path):
    odd = ", ".join(f"Odd{k} 1" for k in range(11))
    far = finals("2026-06-13", ("mixed", f"{BIRDS}, Zebu 1", 15, 3, "mixed"), ("near", "Yak 1", 12, 6), ("far", odd, 9, 9))
    for entry in far:
        entry.lacks = {"near": "Ephemerate", "far": "Ephemerate;Psychic Frog"}.get(entry.who, "")
    found = flags(spark, tmp_path, [*GROUND, *far])
    assert [(f.actor, f.segment, f["mode"], f.delta, f.missing) for f in found] == [("mixed", FULL, "fringe", 1, []), ("near", PLAIN, "fringe", 2, ["Ephemerate"])]


REGULARS = ("rita", "sam", "tom")
OPENING = [
    *crowd("2026-05-25", 9), *league("2026-06-03", *[(who, "") for who in REGULARS]),
    *league("2026-06-17", ("nora", "Nova 1"), ("olaf", ""), ("pia", "")),
]


def test_two_regulars_who_follow_make_a_trend(spark, tmp_path):
    (flag,) = flags(spark, tmp_path, [*OPENING, *league("2026-06-24", ("rita", "Nova 1"), ("x", "")), *league("2026-06-30", ("sam", "Nova 1"), ("y", ""))])
    assert (flag.actor, flag["mode"], flag.delta, flag.state) == ("nora", "fringe", 1, "trendsetter")
    assert (flag.followers, flag.adopted_item, flag.needed) == (2, "Nova", 2)


def test_newcomers_repeats_and_the_late_dont_follow(spark, tmp_path):
    (flag,) = flags(spark, tmp_path, [
        *OPENING, *league("2026-06-22", ("nora", "Nova 1"), ("rita", "Nova 1"), ("new", "Nova 1")), *league("2026-07-08", ("sam", "Nova 1"), ("z", "")),
    ])
    assert (flag.actor, flag.state, flag.followers) == ("nora", "breakthrough", 1)


def ranked(day, arm, places):
    return finals(day, *[(f"{day}/{k}", "Jay 1" if k < arm else "", 6, place) for k, place in enumerate(places)])


def test_a_contrast_that_separates_and_one_that_shows_nothing(spark, tmp_path):
    low = range(17, 60)
    made = store(spark, tmp_path / "a", ranked("2026-06-06", 12, [*range(1, 12), 40, 12, 13, 14, *low[:9]]))
    read = outcome.contrasts(made.items, made.baskets, CFG).where("item = 'Jay' AND arm = '1/0'").first()
    assert (read.with_lists, read.with_made, read.without_lists, read.without_made, read.state) == (12, 11, 12, 3, "separates")
    assert read.p == pytest.approx(sum(comb(12, k) * comb(12, 14 - k) for k in (2, 3, 11, 12)) / comb(24, 14))
    made = store(spark, tmp_path / "b", ranked("2026-06-06", 10, [*range(1, 6), *low[:5], *range(6, 11), *low[5:10]]))
    read = outcome.contrasts(made.items, made.baskets, CFG).where("item = 'Jay' AND arm = 'any count'").first()
    assert (read.with_made, read.without_made, read.difference, read.p, read.state) == (5, 5, 0.0, 1.0, "undetectable") and read.floor > 0.3


def test_conversion_counts_an_actor_once(spark, tmp_path):
    made = store(spark, tmp_path, [*league("2026-06-05", *[("grinder", "Jay 1")] * 3, *[(f"o{k}", "") for k in range(5)]), *ranked("2026-06-06", 0, range(1, 9))])
    read = outcome.contrasts(made.items, made.baskets, CFG).where("item = 'Jay' AND arm = 'board a'").first()
    assert read.league_share == pytest.approx(1 / 6) and read.uncapped == pytest.approx(3 / 8) and read.cap_effect == "collapses"


def test_arms_count_an_actor_once_and_move_no_more_rows_than_tallies(spark):
    """Against each arm's own counts, and dealt by item and actor, never by arm and actor."""
    rng = random.Random(3)
    rows = [
        (n, "s", rng.choice(("league", "challenge")), rng.choice((None, "ann", "ben", "cid")), rng.choice((None, 3, 40)), rng.choice(("Jay", "Owl")), rng.randrange(3), rng.randrange(3))
        for n in range(80)
    ]
    items = spark.createDataFrame(rows, "list_id long, segment string, stratum string, actor string, placement int, item string, qty_a int, qty_b int")
    facts = items.groupBy("segment", "item", "qty_a", "qty_b", "actor").agg(*outcome._tallies(CFG))
    got = outcome._of_actors(outcome._armed(facts), outcome.ARM)
    want = outcome._by_actor(outcome.list_arms(items), outcome.ARM, CFG).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "keys=[segment, item, arm, actor]" not in re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())


def counted(a, b, c, d):
    """The exact test by its definition, over every table of these margins."""
    row, col, n = a + b, a + c, a + b + c + d
    if not (row and c + d and col and b + d):
        return 1.0
    mass = {k: comb(row, k) * comb(n - row, col - k) / comb(n, col) for k in range(max(0, col - c - d), min(row, col) + 1)}
    return min(1.0, sum(m for m in mass.values() if m <= mass[a] + 1e-12))


def test_the_exact_test_agrees_with_every_table_counted(spark):
    rng = random.Random(11)
    tables = [tuple(rng.randrange(most) for _ in range(4)) for most in (3, 12, 90, 700) for _ in range(40)]
    tables += [(0, 0, 0, 0), (5, 0, 0, 5), (900, 3, 2, 800), (1, 60, 60, 1)]
    frame = spark.createDataFrame(tables, "a long, b long, c long, d long").withColumn("p", fisher(*map(F.col, "abcd")))
    for row in frame.collect():
        assert row.p == pytest.approx(counted(*row[:4]), abs=1e-9), row
    big = spark.createDataFrame([(10**7, 10**7 + 9000, 10**7, 10**7)], "a long, b long, c long, d long")
    assert 0 < big.select(fisher(*map(F.col, "abcd")).alias("p")).first().p < 1


def test_the_ledger_remembers(spark):
    row = lambda kind, **v: {"kind": kind, "segment": "s", **v}
    make = lambda *rows: ledger.unified([spark.createDataFrame(list(rows), ledger.LEDGER_SCHEMA)])
    from datetime import date

    day = date(2026, 6, 28)
    first = ledger.merge(ledger.empty(spark), make(row("hype", item="i", qty_a=1, qty_b=0, raised_on=day, state="raised"),
                                                   row("fringe", item="j", qty_a=0, qty_b=1)), "2026-07-01")
    later = ledger.merge(first, make(row("hype", item="i", qty_a=1, qty_b=0, raised_on=day, state="decayed"),
                                     row("fringe", item="k", qty_a=0, qty_b=1)), "2026-07-09")
    told = {(r["kind"], r["item"]): (r["state"], str(r["first_seen"])) for r in later.collect()}
    assert told == {("hype", "i"): ("decayed", "2026-07-01"), ("fringe", "j"): (None, "2026-07-01"), ("fringe", "k"): (None, "2026-07-09")}


def test_lineage_takes_the_first_later_episode_of_the_same_segment(spark):
    from datetime import date

    make = lambda **v: {"first_seen": date(2026, 7, 1), **v}
    slot = [{"item": "i", "qty_a": 1, "qty_b": 0}]
    episode = lambda seg, day, state: make(kind="hype", segment=seg, item="i", qty_a=1, qty_b=0, raised_on=day, state=state, standing="holding")
    rows = [
        make(kind="breakthrough", segment="s", actor="a", event="e", date=date(2026, 5, 29), novel=slot, missing=[], state="trendsetter"),
        make(kind="breakthrough", segment="s", actor="b", event="e", date=date(2026, 8, 1), novel=slot, missing=[], state="watching"),
        episode("t", date(2026, 6, 1), "decayed"), episode("s", date(2026, 6, 21), "established"), episode("s", date(2026, 7, 5), "raised"),
    ]
    traced = ledger.lineage(spark.createDataFrame(rows, ledger.LEDGER_SCHEMA)).collect()
    assert [(r.actor, str(r.spiked_on), r.resolved) for r in traced] == [("b", "None", None), ("a", "2026-06-21", "established")]


def test_follow_through_sends_no_departures_or_actors_to_all_tasks(spark, tmp_path):
    made = store(spark, tmp_path, [*OPENING, *league("2026-06-24", ("rita", "Nova 1"), ("x", "")), *league("2026-06-30", ("sam", "Nova 1"), ("y", ""))])
    found = departures.departures(made.items, made.baskets, CFG)
    found.write.parquet(str(tmp_path / "found"))
    flags = departures.breakthroughs(made.items, made.baskets, CFG, spark.read.parquet(str(tmp_path / "found")))
    assert [r.followers for r in flags.collect()] == [2]
    said = re.sub(r"#\d+L?", "", flags._jdf.queryExecution().executedPlan().toString())
    for keys in ("[item, date], [item, date]", "[actor], [actor]", "[list_id], [list_id]"):
        assert f"SortMergeJoin {keys}" in said and f"BroadcastHashJoin {keys}" not in said, keys
