"""The standing store and ledger: versions, refreshes that touch what changed, and sessions that find them again."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import worlds
from basketlens.config import DECKLISTS
from basketlens.operators import adoption, hype, ledger, scope
from basketlens.sources import episodes, ledgers, standing, star
from basketlens.sources.store import build as whole
from basketlens.sources.versions import Conflict, Versions

CFG = DECKLISTS


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.glob("data/*/*/*.parquet")}


# ---- Versions -----------------------------------------------------------------------


def numbers(spark, *rows):
    return spark.createDataFrame([(n, str(n % 3)) for n in rows], "n int, third string")


def put(versions, base, frame):
    return versions.commit(base, {"t": versions.write(frame, "t", F.col("third"), "n")}, {"t": "n int, third string"})


def held(pinned):
    return sorted(row.n for row in pinned.read("t").collect())


def test_a_reader_keeps_its_version_and_others_find_the_next(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.current() is None and versions.open().parts("t") == {}
    put(versions, versions.open(), numbers(spark, 0, 1, 2, 3))
    reader = versions.open()
    elsewhere = Versions(spark.newSession(), str(tmp_path))
    with elsewhere.open() as base:
        assert put(elsewhere, base, numbers(spark, 4, 7)) == 2
    assert held(reader) == [0, 1, 2, 3]
    with versions.open() as new:
        assert held(new) == [0, 2, 3, 4, 7]
        # The part that wasn't replaced is the same folder.
        assert new.parts("t")["0"] == reader.parts("t")["0"] and new.parts("t")["1"] != reader.parts("t")["1"]
    assert versions.tidy() == []
    reader.close()
    assert [path.split("/")[-1] for path in versions.tidy()] == ["part=1"]
    assert versions.numbers() == [2]
    with pytest.raises(FileNotFoundError):
        versions.open(1)
    with versions.open() as now:
        assert held(now) == [0, 2, 3, 4, 7]


def test_a_writer_that_dies_or_comes_second_leaves_the_version_alone(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    put(versions, versions.open(), numbers(spark, 1, 2))
    one, two = versions.open(), versions.open()
    versions.write(numbers(spark, 8), "t", F.col("third"), "n")  # and no commit
    with versions.open() as now:
        assert held(now) == [1, 2]
    put(versions, one, numbers(spark, 5))
    with pytest.raises(Conflict):
        put(versions, two, numbers(spark, 11))
    one.close(), two.close()
    with versions.open() as now:
        assert held(now) == [1, 5]
    # The part of 2 that 5 replaced, and those of the dead and of the second writer.
    assert len(versions.tidy()) == 3
    with versions.open() as now:
        assert held(now) == [1, 5]


def test_a_part_that_lost_all_rows_is_named_no_more(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    put(versions, versions.open(), numbers(spark, 0, 1))
    with versions.open() as base:
        versions.commit(base, {"t": {"1": None}}, {})
    with versions.open() as now:
        assert held(now) == [0] and now.read("t", ["1"]).count() == 0


# ---- The store ----------------------------------------------------------------------

DAYS = [date(2026, 6, 1) + timedelta(days=n) for n in range(0, 24)]


def history():
    """A league every other day, a final every third; holds differ by seat."""
    out = []
    for n, day in enumerate(DAYS):
        if n % 2 == 0:
            out += worlds.league(day.isoformat(), *[(f"a{k}", "Kite 1" if k < n % 5 else "Oak 2/1", ("plain", "full", "mixed")[k % 3]) for k in range(5)])
        if n % 3 == 0:
            out += worlds.finals(day.isoformat(), *[(f"b{k}", "Kite 1" if k % 2 else "Elm 1", 9 - k, k + 1) for k in range(4)])
    return out


def raw(spark, tmp_path, name, entries):
    """Published lists and entries: numbered by their place in the whole history."""
    made = worlds.store(spark, tmp_path / name, entries)
    columns = ["list_id", "actor", "event", "event_id", "event_class", "date", "placement", "points", "record"]
    items = made.items.select("list_id", "item", F.explode(F.array(F.struct(F.lit("a").alias("board"), "qty_a"), F.struct(F.lit("b").alias("board"), F.col("qty_b").alias("qty_a")))).alias("on"))
    entries = items.select("list_id", "on.board", F.col("on.qty_a").alias("qty"), F.col("item").alias("name"), F.when(F.col("item") == "Marsh", "LAND").otherwise("SPELL").alias("type"))
    return made.baskets.select(*columns), entries.where("qty > 0")


def told(frame, *drop):
    columns = sorted(set(frame.columns) - set(drop))
    shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in frame.select(*columns).dtypes]
    return sorted(map(str, frame.select(*shown).collect()))


def test_a_refresh_equals_a_rebuild_and_leaves_settled_files(spark, tmp_path):
    baskets, entries = raw(spark, tmp_path, "raw", history())
    last = DAYS[-1]
    edge = last - timedelta(days=CFG.unsettled_days)
    number = F.col("list_id")
    gap = F.col("event_id").contains("2026-06-07")
    first = baskets.where((F.col("date") <= F.lit(edge)) & ~gap & ~((F.col("date") == F.lit(edge)) & (number % 3 == 0)))
    second = baskets.where(~((F.col("date") >= F.lit(edge)) & (number % 4 == 0)) & ~((F.col("date") < F.lit(edge)) & (number % 5 == 0) & ~gap))
    versions = Versions(spark, str(tmp_path / "standing"))
    standing.build(versions, first, entries, CFG)
    old_files = files(tmp_path / "standing")
    reader = standing.open_store(versions, CFG)
    before = told(reader.baskets)
    done = standing.refresh(versions, second, entries, last.isoformat(), CFG)
    assert done.version == 2 and told(reader.baskets) == before

    # Settled days stay as they were published first, days since and the gap are as published now.
    state = first.where(F.col("date") < F.lit(edge)).unionByName(second.where((F.col("date") >= F.lit(edge)) | gap))
    want = whole(state, entries.join(state.select("list_id"), "list_id", "left_semi"), spark.createDataFrame([], "x int"), CFG, str(tmp_path / "want"))
    with standing.open_store(versions, CFG) as now:
        assert told(now.baskets) == told(want.baskets)
        assert told(now.items.select(want.items.columns)) == told(want.items)
        assert told(now.tallies) == told(hype.tally_by_day(want.items))
        assert told(now.populations) == told(hype.population_by_day(want.baskets))
        assert told(adoption.from_tallies(now.tallies, now.populations, CFG)) == told(adoption.adoption(want.items, want.baskets, CFG))
        got, direct = hype.sliding_from_tallies(now.tallies, now.populations, CFG), hype.sliding_adoption(want.items, want.baskets, CFG)
        assert told(got) == told(direct) and got.count()
        settled = [d.isoformat() for d in DAYS if d < edge and d.isoformat() != "2026-06-07"]
        for table in ("baskets", "items", "tallies", "populations"):
            for day in settled:
                assert now.pinned.parts(table).get(day) == reader.pinned.parts(table).get(day)
    assert {k: v for k, v in files(tmp_path / "standing").items() if k in old_files} == old_files
    assert set(done.parts) == {d.isoformat() for d in DAYS if d >= edge and (d - DAYS[0]).days % 6 in (0, 2, 3, 4)} | {"2026-06-07"}
    assert done.withdrawn.count() == first.where(F.col("date") == F.lit(edge)).join(second, "list_id", "left_anti").count()
    reader.close()


def test_a_new_best_total_changes_the_weight_of_settled_lists(spark, tmp_path):
    """An event over several days: its late winner moves a settled list's weight, and that day is written anew."""
    shape = "list_id bigint, actor string, event string, event_id string, event_class string, date date, placement int, points int, record string"
    rows = [(1, "x", "e", "long", "challenge", DAYS[0], 2, 6, None), (2, "y", "e", "other", "challenge", DAYS[0], 1, 9, None), (3, "z", "e", "long", "challenge", DAYS[9], 1, 12, None)]
    published = spark.createDataFrame(rows, shape)
    items = spark.createDataFrame([(n, "a", 1, card, "SPELL") for n in (1, 2, 3) for card in CFG.signature], "list_id bigint, board string, qty int, name string, type string")
    versions = Versions(spark, str(tmp_path))
    standing.build(versions, published.where("list_id < 3"), items, CFG)
    done = standing.refresh(versions, published, items, DAYS[9].isoformat(), CFG)
    assert done.parts == [DAYS[0].isoformat(), DAYS[9].isoformat()]
    with standing.open_store(versions, CFG) as now:
        assert {r.list_id: r.weight for r in now.baskets.collect()} == {1: 0.5, 2: 1.0, 3: 1.0}
        assert {r.list_id: r.weight for r in now.items.select("list_id", "weight").distinct().collect()} == {1: 0.5, 2: 1.0, 3: 1.0}
    # Everything of the open days withdrawn: the day is gone, and so is its effect.
    standing.refresh(versions, published.where("list_id < 3"), items, DAYS[9].isoformat(), CFG)
    with standing.open_store(versions, CFG) as now:
        assert {r.list_id: r.weight for r in now.baskets.collect()} == {1: 1.0, 2: 1.0}
        assert DAYS[9].isoformat() not in now.pinned.parts("items")


def test_an_open_day_that_takes_the_id_of_a_settled_list_is_written(spark, tmp_path):
    """What a list weighed before goes with its row and isn't looked up by its id."""
    shape = "list_id bigint, actor string, event string, event_id string, event_class string, date date, placement int, points int, record string"
    rows = [(1, "x", "e", "one", "league", DAYS[0], None, None, None), (1, "y", "e", "two", "league", DAYS[9], None, None, None)]
    published = spark.createDataFrame(rows, shape)
    items = spark.createDataFrame([(1, "a", 1, card, "SPELL") for card in CFG.signature], "list_id bigint, board string, qty int, name string, type string")
    versions = Versions(spark, str(tmp_path))
    standing.build(versions, published.where("actor = 'x'"), items, CFG)
    done = standing.refresh(versions, published, items, DAYS[9].isoformat(), CFG)
    assert done.parts == [DAYS[9].isoformat()]
    with standing.open_store(versions, CFG) as now:
        assert told(now.baskets.select("actor", "date")) == told(published.select("actor", "date"))


def test_no_table_of_lists_or_parts_is_sent_to_all_tasks(spark, tmp_path):
    """Small files of many rows, as compressed ones are: a size check alone would broadcast them."""
    listed = spark.range(3).select(F.col("id").alias("list_id"), *[F.lit(1).alias(c) for c in scope.LIST_COLUMNS[1:]])
    listed.write.parquet(str(tmp_path / "listed"))
    spark.range(3).select(F.col("id").alias("list_id"), F.lit("Kite").alias("item")).write.parquet(str(tmp_path / "held"))
    spark.range(3).selectExpr("id AS l_orderkey", "id AS l_partkey", "'F' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(3).selectExpr("id AS p_partkey", "'T' AS p_type", "'B' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    attached = scope.attach(spark.read.parquet(str(tmp_path / "held")), spark.read.parquet(str(tmp_path / "listed")))
    for frame, rows in ((attached, 3), (star.item_entries(spark, str(tmp_path)), 6)):
        assert frame.count() == rows
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)


def test_a_first_version_sends_no_ids_of_lists_to_all_tasks(spark, tmp_path, monkeypatch):
    spark.range(6).select(F.col("id").alias("list_id")).write.parquet(str(tmp_path / "lists"))
    rows = [(k, "a", 1, name, "T") for k in range(0, 12, 2) for name in ("Kite", "Owl")]
    spark.createDataFrame(rows, "list_id long, board string, qty int, name string, type string").write.parquet(str(tmp_path / "entries"))
    seen = []
    monkeypatch.setattr(standing, "settled", lambda frame, name: seen.append(frame) or frame.localCheckpoint())
    monkeypatch.setattr(standing, "labelled", lambda *_: pytest.fail("counted by now"))
    monkeypatch.setattr(standing, "finish_weights", lambda _: pytest.fail("counted by now"))
    with pytest.raises(pytest.fail.Exception, match="counted by now"):
        standing.build(Versions(spark, str(tmp_path / "standing")), spark.read.parquet(str(tmp_path / "lists")), spark.read.parquet(str(tmp_path / "entries")), CFG)
    (counted,) = seen
    assert sorted((r.list_id, r["item"]) for r in counted.collect()) == [(k, name) for k in (0, 2, 4) for name in ("Kite", "Owl")]
    assert "LeftSemi" in plan(counted) and "Broadcast" not in plan(counted)


def test_a_run_compared_with_the_ledger_sends_no_flags_to_all_tasks(spark, tmp_path, monkeypatch):
    """Nor does lineage: departures and their items grow with the history."""
    flag = {"kind": "breakthrough", "segment": "s", "actor": "a", "event": "e", "date": date(2026, 5, 29), "novel": [{"item": "i", "qty_a": 1, "qty_b": 0}], "missing": []}
    spark.createDataFrame([flag], ledger.LEDGER_SCHEMA).write.parquet(str(tmp_path / "found"))
    found = spark.read.schema(ledger.LEDGER_SCHEMA).parquet(str(tmp_path / "found"))
    versions = Versions(spark, str(tmp_path / "ledger"))
    ledgers.record(versions, found, "2026-06-01")
    kinds, joined = [], type(found).join
    monkeypatch.setattr(type(found), "join", lambda one, two, *how: kinds.append(joined(one, two, *how)) or kinds[-1])
    ledgers.record(versions, found, "2026-06-02")
    assert [r.actor for r in ledger.lineage(ledgers.load(versions)[0]).collect()] == ["a"]
    assert len(kinds) == 3
    for frame in kinds:
        frame.collect()
        assert "SortMergeJoin" in plan(frame) and "BroadcastHashJoin" not in plan(frame)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# ---- Episodes -----------------------------------------------------------------------


def counts(spark, days, change=0):
    """Counts of days from a fixed rule: three cards whose share of 40 league lists swings at their own pace."""
    first = date.fromisoformat(CFG.epoch_start)
    tallies, populations = [], []
    for n in range(days):
        day = first + timedelta(days=n)
        populations.append((True, "plain", day, 40, 4, 2.0))
        for card, pace in (("Kite", 2), ("Oak", 3), ("Elm", 5)):
            high = (n // 7) % pace == 1 or (change and card == "Elm" and n // 7 == change)
            tallies.append(("plain", card, 1, 0, day, 30 if high else 0, 1, 1.0, hype.PLACE_STEP + (day - date(1970, 1, 1)).days))
    return (
        spark.createDataFrame(tallies, "segment string, item string, qty_a int, qty_b int, date date, league bigint, challenge bigint, weight double, best bigint"),
        spark.createDataFrame(populations, "member boolean, segment string, date date, league bigint, challenge bigint, weight double"),
    )


def folded(days):
    leaps = hype.spikes_from_tallies(*days, CFG).select(*episodes.LEAP)
    return hype.accepted(leaps, hype.KEY, "end", CFG.hype_window_days)


def test_episodes_fold_on_from_any_day_to_those_of_the_whole_history(spark, tmp_path):
    first = date.fromisoformat(CFG.epoch_start)
    home = Versions(spark, str(tmp_path / "steps"))
    for n, reach in enumerate((1, 33, 40, 41, 90, 120)):
        days = counts(spark, reach)
        assert episodes.advance(home, *days, [(first + timedelta(days=reach - 1)).isoformat()], CFG) == n + 1
        assert told(episodes.load(home)) == told(folded(days))
    assert episodes.load(home).count() > 6
    # A day in the past reads otherwise: months before it keep their files, those from it on are folded anew.
    days = counts(spark, 120, change=10)
    week = [(first + timedelta(days=70 + k)).isoformat() for k in range(7)]
    before = home.open().parts("episodes")
    episodes.advance(home, *days, week, CFG)
    assert told(episodes.load(home)) == told(folded(days)) != told(folded(counts(spark, 120)))
    after = home.open().parts("episodes")
    assert {m for m in before if after.get(m) == before[m]} == {m for m in before if m < week[0][:7]} != set()
    # The last days are withdrawn.
    days = counts(spark, 100, change=10)
    episodes.advance(home, *days, [(first + timedelta(days=100)).isoformat()], CFG)
    assert told(episodes.load(home)) == told(folded(days))


def test_no_days_make_no_episodes(spark, tmp_path):
    home = Versions(spark, str(tmp_path))
    none = tuple(frame.where("false") for frame in counts(spark, 1))
    assert episodes.advance(home, *none, [], CFG) == 1 and episodes.load(home).count() == 0
    days = counts(spark, 60)
    episodes.advance(home, *days, [], CFG)
    assert told(episodes.load(home)) == told(folded(days))


# ---- The ledger ---------------------------------------------------------------------


def flags(spark, *rows):
    """Fringe flags (segment, item, share) in the ledger's shape."""
    shape = "segment string, item string, historical_adoption double"
    return ledger.unified([spark.createDataFrame(list(rows), shape).withColumn("kind", F.lit("fringe"))])


def test_three_sessions_keep_first_seen_and_rewrite_only_what_changed(spark, tmp_path):
    crowd = [("plain", f"card {n}", 0.1) for n in range(60)]
    runs = [crowd, [*crowd[1:], ("plain", "new", 0.0)], [("plain", "card 5", 0.2)]]
    kept = []
    for n, rows in enumerate(runs):
        versions = Versions(spark.newSession(), str(tmp_path))
        assert ledgers.record(versions, flags(spark, *rows), f"2026-07-0{n + 1}", buckets=8) == n + 1
        kept.append(versions.open().parts("ledger"))
    found, hold = ledgers.load(Versions(spark.newSession(), str(tmp_path)))
    said = {row["item"]: (row["first_seen"].day, row["historical_adoption"]) for row in found.collect()}
    assert said == {f"card {n}": (1, 0.2 if n == 5 else 0.1) for n in range(60)} | {"new": (2, 0.0)}
    assert [sum(a.get(k) != b[k] for k in b) for a, b in zip(kept, kept[1:], strict=False)] == [1, 1]
    assert len(kept[0]) == 8
    # A run that says nothing new commits nothing.
    assert ledgers.record(Versions(spark, str(tmp_path)), flags(spark, ("plain", "card 7", 0.1)), "2026-07-09") == 3
    old, _ = ledgers.load(Versions(spark, str(tmp_path)), 1)
    assert old.count() == 60
    hold.close()


def test_an_empty_ledger_and_an_empty_run(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    found, _ = ledgers.load(versions)
    assert found.count() == 0
    assert ledgers.record(versions, flags(spark, ("s", "i", 0.0)).where("false"), "2026-07-01") == 1
    found, _ = ledgers.load(versions)
    assert found.count() == 0 and found.columns == ledger.empty(spark).columns
