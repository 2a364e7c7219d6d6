"""Reference baskets against a population written down as list counts."""

import pytest

from basketlens.config import DECKLISTS as CFG
from basketlens.operators import ledger, reference, subjects

READ = ("segment string, stratum string, item string, qty_a int, qty_b int, fresh_lists bigint, fresh_population bigint, "
        "fresh_adoption double, fresh_tilt double, delta double")
REF = "owner string, version int, item string, qty_a int, qty_b int, override string, note string"


def adopted(spark, *rows, population=10, segment="non-fallaji"):
    made = [(segment, "challenge-class", i, a, b, n, population, n / population, None, 0.0) for i, a, b, n in rows]
    return spark.createDataFrame(made, READ)


def held(spark, *rows, owner="me", version=1):
    return spark.createDataFrame([(owner, version, *r) for r in rows], REF)


def test_slots_fall_into_core_and_four_buckets(spark):
    read = adopted(spark, ("Core", 4, 0, 10), ("Most", 2, 0, 6), ("Some", 1, 0, 2), ("Split", 1, 0, 4), ("Split", 2, 0, 6), ("Forced", 1, 0, 3))
    ref = held(spark, ("Core", 4, 0, None, None), ("Most", 2, 0, None, None), ("Some", 1, 0, None, None), ("Split", 1, 0, "flex", "why"),
               ("Mine", 1, 0, None, "a reason"), ("Odd", 0, 1, None, None), ("Forced", 1, 0, "core", None), ("Out", 0, 0, None, "left"))
    got = {r.item: r for r in reference.slots(ref, read, CFG).collect()}
    assert {i: (r.core, r.bucket) for i, r in got.items()} == {
        "Core": (True, None), "Most": (False, "consensus"), "Some": (False, "supported-minority"), "Split": (False, "supported-minority"),
        "Mine": (False, "deliberate-deviation"), "Odd": (False, "unexamined-deviation"), "Forced": (True, None)}
    assert (got["Split"].segment_playing, got["Split"].lead_a, got["Split"].lists) == (1.0, 2, 4)
    assert (got["Core"].boundary, got["Most"].boundary, got["Some"].boundary, got["Forced"].boundary) == ("core", "consensus", "supported-minority", None)


def test_missing_core_is_about_the_item_and_keeps_the_reason(spark):
    read = adopted(spark, ("Split", 1, 0, 6), ("Split", 0, 1, 4), ("Near", 1, 0, 9), ("Half", 1, 0, 5), ("Own", 1, 0, 10), ("Noted", 2, 0, 10))
    ref = held(spark, ("Own", 3, 0, None, None), ("Noted", 0, 0, None, "no room"))
    audit, lacking = reference.slots(ref, read, CFG), reference.missing_core(ref, read, CFG)
    got = {r.item: (r.confidence, r.segment_playing, r.lead_a, r.lead_b, r.note) for r in lacking.collect()}
    assert set(got) == {"Split", "Near", "Noted"}
    assert got["Split"] == (0.0, 1.0, 1, 0, None) and got["Near"][0] == pytest.approx(0.1) and got["Noted"][4] == "no room"
    queue = [r.item for r in reference.playtest_queue(audit, lacking).collect()]
    assert queue == ["Own", "Split", "Noted", "Near"], "least backed first, an unnoted slot before a noted one, then by name"


def test_unplayed_reports_what_the_cap_cut(spark):
    read = adopted(spark, ("Six", 1, 0, 6), ("One", 1, 0, 1), ("Mine", 1, 0, 9), population=8)
    ref = held(spark, ("Mine", 1, 0, None, None))
    (row,) = reference.unplayed(ref, read, CFG).collect()
    assert (row.item, row.segment_playing, row.confidence, row.dropped) == ("Six", 0.75, 0.25, 0)
    assert [r.item for r in reference.unplayed(ref, read, CFG, floor=0.1).collect()] == ["Six", "One"]
    assert [(r.item, r.dropped) for r in reference.unplayed(ref, read, CFG, floor=0.1, limit=1).collect()] == [("Six", 1)]


def test_changes_meet_over_every_pair_of_versions(spark):
    ref = held(spark, ("A", 4, 0, None, None), ("B", 2, 0, None, None), ("C", 1, 0, None, None)).union(
        held(spark, ("A", 3, 0, None, None), ("B", 2, 0, None, None), ("C", 0, 0, None, "cut"), version=3)).union(
        held(spark, ("A", 3, 0, None, None), ("B", 0, 2, None, None), version=4))
    got = {(r.from_version, r.to_version, r.item): (r.before_a, r.before_b, r.after_a, r.after_b) for r in reference.changes(ref).collect()}
    assert got == {(1, 3, "A"): (4, 0, 3, 0), (1, 3, "C"): (1, 0, None, None), (3, 4, "B"): (2, 0, 0, 2)}


def test_a_segment_without_lists_is_refused_when_strict(spark):
    ref = held(spark, ("Own", 3, 0, None, None))
    away = adopted(spark, ("Own", 3, 0, 5), segment="fallaji")
    assert reference.slots(ref, away, CFG).count() == 0
    with pytest.raises(Exception, match="no fresh challenge-class lists"):
        reference.slots(ref, away, CFG, strict=True).collect()


def test_subjects_speak_stay_silent_or_are_unknown(spark):
    read = adopted(spark, ("W", 1, 3, 2), ("W", 0, 4, 1), ("Gone", 1, 0, 0), population=3)
    totals = spark.createDataFrame([("non-fallaji", "challenge-class", 21, 3, 3, 1.0, None, 0.1)],
                                   "segment string, stratum string, typed_total int, fresh_lists bigint, fresh_population bigint, fresh_adoption double, fresh_tilt double, delta double")
    asked = spark.createDataFrame([("h", "W", None), ("h", "Gone", None), ("h", "Typo", None), ("h", "lands", None)],
                                  "hypothesis_id string, subject string, conditional_on string")
    spoken = subjects.readings(asked, read, totals)
    assert {(r.segment, r.subject, r.configuration) for r in spoken.collect()} == {("non-fallaji", *r) for r in (("W", "1/3"), ("W", "0/4"), ("lands", "21"))}
    pool = spark.createDataFrame([("W",), ("Gone",)], "item string")
    still = {(r.segment, r.subject): r.reading for r in subjects.quiet(asked, spoken, pool, CFG).collect()}
    assert {subject: told for (segment, subject), told in still.items() if segment == "non-fallaji"} == {"Gone": "silent", "Typo": "unknown"}
    assert {subject: told for (segment, subject), told in still.items() if segment == "hybrid"} == {"W": "silent", "Gone": "silent", "Typo": "unknown", "lands": "silent"}
    flag = spark.createDataFrame([{"kind": "hype", "segment": "non-fallaji", "item": "W", "qty_a": 1, "qty_b": 3, "state": "established"},
                                  {"kind": "hype", "segment": "fallaji", "item": "W", "qty_a": 1, "qty_b": 3}], ledger.LEDGER_SCHEMA)
    raised = {r.segment: r for r in subjects.flagged(asked, flag).collect()}
    assert set(raised) == {"non-fallaji", "fallaji"}
    row = raised["non-fallaji"]
    assert (row.subject, row.state, row.caveat) == ("W", "established", subjects.HYPE_CAVEAT)


def test_baskets_are_not_laid_out_by_item_to_find_what_they_lack(spark):
    """A basket's gaps are read in its own row: no join of all baskets with all common items, and no window over them."""
    shape = "segment string, stratum string, item string, qty_a int, qty_b int, fresh_lists long, fresh_population long, fresh_adoption double, fresh_tilt double, delta double"
    read = spark.createDataFrame([("non-fallaji", "challenge-class", item, 1, 0, n, 10, n / 10, 0.0, 0.0) for item, n in (("B", 9), ("A", 9), ("C", 5), ("D", 1), (None, 4))], shape)
    rows = [("x", 1, "A", 1, 0), ("x", 1, "C", 0, 0), ("x", 1, None, 1, 0), ("y", 1, "A", 1, 1), ("y", 1, "B", 1, 0), ("y", 1, "C", 2, 0), (None, 1, "A", 1, 0)]
    asked = spark.createDataFrame([(*row, None, None) for row in rows], "owner string, version int, item string, qty_a int, qty_b int, override string, note string")
    found = reference.unplayed(asked, read, CFG, floor=0.3, limit=2)
    assert {(r.owner, r.rank, r["item"], r.dropped, r.found) for r in found.collect()} == {
        ("x", 1, "B", 1, 3), ("x", 2, "C", 0, 3), ("y", 1, None, 0, 1), (None, 1, "A", 2, 4), (None, 2, "B", 0, 4),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "Window" not in plan
