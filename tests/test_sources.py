import json
from dataclasses import replace
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from worlds import finals, land, league

from basketlens.config import DECKLISTS as CFG
from basketlens.operators import composition, ingest, scope, weekly
from basketlens.plans import derived
from basketlens.session import settled
from basketlens.sources import captures, matchlogs, payload, snapshots
from basketlens.sources import store as stores
from basketlens.streaming import arrivals


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    entries = [
        *league("2026-06-02", ("zoe", "Superior Spider-Man 2, Kavaero, Mind-Bitten 0/1"), ("zoe", "", "mixed")),
        *finals("2026-06-06", ("amy", "", 9, 2), ("bea", "Marsh 17/4", 6, 1), number=4),
        *finals("2026-06-07", ("cal", "", 3, 6), ("deb", "", 0, 11), number=5),
    ]
    entries[-1].lacks = "Atraxa, Grand Unifier"
    land(spark, root, entries, final=[(entries[2].event, "amy", 1), (entries[2].event, "bea", 2)])
    twin = json.loads((root / f"{entries[0].event}.json").read_text())
    twin["decklists"][0]["player"] = "twin"
    (root / "zz-twin.json").write_text(json.dumps(twin, indent=1))
    return str(root)


def test_payloads_of_both_shapes_make_one_store(spark, folder, tmp_path):
    none = spark.createDataFrame([], "captured_on date, window_days int, cohort string, share double, deck_count int")
    made = payload.store(spark, folder, none, CFG)
    lists = {(r.actor, r.segment): r for r in made.baskets.collect()}
    assert len(lists) == 6 and not any(actor == "twin" for actor, _ in lists), "a second file of one event is not read"
    plain = CFG.segments[1][0]
    assert (lists["amy", plain].placement, lists["bea", plain].placement) == (1, 2), "the final ranking stands"
    assert (lists["cal", plain].placement, lists["cal", plain].points) == (6, 3)
    assert (lists["cal", plain].event_class, lists["cal", plain].record) == ("challenge-32", "1-2")
    zoe = lists["zoe", plain]
    assert (zoe.placement, zoe.points, zoe.record, zoe.event_class, zoe.stratum) == (None, None, "4-1", "league", "league")
    assert (str(zoe.date), zoe.typed_total) == ("2026-06-02", 17)
    assert lists["bea", plain].typed_total == 17, "the total is board a's alone"
    assert lists["deb", None].near_miss and not lists["deb", None].member
    assert ("zoe", "hybrid") in lists, "one actor's two lists stay two"
    merged = made.items.where((F.col("list_id") == zoe.list_id) & (F.col("item") == "Kavaero, Mind-Bitten")).first()
    assert (merged.qty_a, merged.qty_b) == (2, 1)


def test_a_day_that_is_not_one_is_refused(spark, tmp_path):
    land(spark, tmp_path, league("2026-06-02", ("amy", "")))
    (path,) = tmp_path.glob("*.json")
    path.write_text(json.dumps(json.loads(path.read_text()) | {"publish_date": "2026-6-2"}))
    with pytest.raises(Exception, match="not an ISO day"):
        payload.baskets(payload.scan(spark, str(tmp_path))).collect()


def test_the_index_counts_two_equal_rows_as_two_lists(spark):
    shape = "list_id bigint, date date, event_id string, event_class string, actor string, placement int, points int"
    at = lambda n, actor, place=None: (n, date(2026, 6, 1), "e", "league", actor, place, None)
    before = ingest.index_rows(spark.createDataFrame([at(1, "a"), at(2, "b")], shape))
    after = ingest.index_rows(spark.createDataFrame([at(1, "a"), at(3, "a"), at(4, "c", 10), at(5, "d", 9)], shape))
    added = ingest.difference(after, before)
    assert sorted(r.actor for r in added.collect()) == ["a", "c", "d"]
    assert [r.actor for r in ingest.difference(before, after).collect()] == ["b"]
    assert [r.actor for r in ingest.ordered(after).collect()] == ["d", "c", "a", "a"], "placement orders as a number, unranked last"


def test_only_gaps_and_unsettled_days_are_read_again(spark):
    days = [("old", date(2026, 7, 1)), ("gap", date(2026, 7, 2)), ("edge", date(2026, 7, 7)), ("now", date(2026, 7, 10)), ("ahead", date(2026, 7, 11))]
    listed = spark.createDataFrame(days, "event_id string, date date")
    held = listed.where("event_id <> 'gap'")
    again = ingest.to_refresh(listed, held, "2026-07-10", CFG)
    assert sorted(r.event_id for r in again.collect()) == ["edge", "gap", "now"]


def test_a_refresh_fills_gaps_rereads_the_last_days_and_leaves_the_rest(spark, tmp_path):
    shape = "date string, event_id string, event_class string, actor string, placement string, points string"
    row = lambda day, event, actor: (f"2026-{day}", event, "league", actor, "", "")
    path = str(tmp_path / "index")
    refreshed = lambda lists: ingest.refresh(path, spark.createDataFrame(lists, shape), "2026-07-10", CFG)
    ingest.write_index(spark.createDataFrame([row("05-01", "a", "x"), row("05-01", "a", "gone"), row("07-08", "c", "y"), row("07-09", "d", "z")], shape), path)
    may = sorted((tmp_path / "index" / "month=2026-05").glob("*.parquet"))
    now = [row("05-01", "a", "x"), row("06-02", "b", "w"), row("07-08", "c", "y"), row("07-08", "c", "y2"), row("07-10", "e", "v")]
    added, withdrawn = refreshed(now)
    assert sorted(r.actor for r in added.collect()) == ["v", "w", "y2"]
    assert [r.actor for r in withdrawn.collect()] == ["z"], "a settled day keeps what it holds"
    assert sorted(r.actor for r in ingest.read_index(spark, path).collect()) == ["gone", "v", "w", "x", "y", "y2"]
    assert [frame.count() for frame in refreshed(now)] == [0, 0]
    assert may == sorted((tmp_path / "index" / "month=2026-05").glob("*.parquet")), "months without a change aren't rewritten"
    refreshed([r for r in now if r[0] < "2026-07"])
    assert sorted(r.actor for r in ingest.read_index(spark, path).collect()) == ["gone", "w", "x"]


def test_share_tables_merge_aliases_and_never_pool_windows(spark, tmp_path):
    shape = "archetype string, meta_pct string, deck_count string"
    table = spark.createDataFrame([("Eldrazi", "5.0", "60"), ("Gruul Basking Broodscale Combo", "2.5", "30"), ("Goryo's Vengeance", "10.0", "118")], shape)
    kept = str(tmp_path / "kept")
    snapshots.ingest(table, "2026-08-07", 14, kept)
    snapshots.ingest(table, "2026-08-07", 30, kept)
    snapshots.ingest(table, "2026-08-07", 14, kept)
    read = snapshots.shares(snapshots.scan(spark, kept), CFG)
    got = {(r.window_days, r.cohort): (round(r.share, 9), r.deck_count) for r in read.collect()}
    assert got[14, "Broodscale"] == (0.075, 90) and got[30, "Goryo's Vengeance"] == (0.1, 118) and len(got) == 4
    days = spark.createDataFrame([(date(2026, 8, 6),), (date(2026, 8, 9),)], "day date")
    stood = composition.share_as_of(days, read, CFG.share_cohort, 14).orderBy("day").collect()
    assert [(str(r.captured_on), r.deck_count) for r in stood] == [("None", None), ("2026-08-07", 118)]


def test_a_table_that_is_wrong_is_refused(spark, tmp_path):
    table = spark.createDataFrame([("X", "1.0", "1", "2026-08-07", "14")], "archetype string, meta_pct string, deck_count string, captured_on string, window_days string")
    assert snapshots.stamped(table, "2026-08-07", 14).count() == 1
    for day, window, source, fault in (("2026-08-08", 14, table, "stamped"), ("2026-8-7", 14, table, "ISO"), ("2026-08-07", 14, table.where("false"), "no cohorts")):
        with pytest.raises(ValueError, match=fault):
            snapshots.stamped(source, day, window)
    (tmp_path / "foreign.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        snapshots.scan(spark, str(tmp_path)).collect()


def test_captures_carry_boards_overrides_and_notes(spark, tmp_path):
    (tmp_path / "v1-start.txt").write_text("# from somewhere\nMainboard\n4 Plain\n1 Superior Spider-Man\n1 Kavaero, Mind-Bitten  # core: keep it\n\nSIDEBOARD\n2 Plain\n")
    (tmp_path / "v2-next.txt").write_text("Mainboard\n3 Plain  # core to the plan, never cut\n0 Left Out  # flex: no room\nSideboard\n1 Other # flex\n")
    (tmp_path / "vnotes.txt").write_text("Mainboard\n1 Nothing\n")
    read = captures.read(captures.scan(spark, str(tmp_path), "me"), CFG).cache()
    got = {(r.version, r.item): (r.qty_a, r.qty_b, r.override, r.note) for r in read.collect()}
    assert got == {
        (1, "Plain"): (4, 2, None, None), (1, "Kavaero, Mind-Bitten"): (2, 0, "core", "keep it"),
        (2, "Plain"): (3, 0, None, "core to the plan, never cut"), (2, "Left Out"): (0, 0, "flex", "no room"), (2, "Other"): (0, 1, "flex", None)}
    assert {r.version for r in captures.current(read).collect()} == {2}


def test_match_logs_decide_on_the_line_or_on_two_games(spark, tmp_path):
    said = {
        "b-7": ["@Pkay_9 rolled a 4.", "@PLev-2 rolled a 1.", "@PLev-2 casts @[Oak@:5,9:@].", "@PLev-2 casts @[Elm@:5,9:@].", "@PLev-2 plays @[Oak@:5,8:@].",
               "@PLev-2 wins the game.", "@Pkay_9 wins the game.", "@PLev-2 wins the game.", "@PLev-2 wins the match 2-1"],
        "b-8": ["@Pmo rolled a 2.", "@Pned rolled a 5.", "@Pmo casts @[Ash@:1,1:@].", "@Pmo wins the game.", "@Pmo wins the game."],
        "b-9": ["@Pmo rolled a 6.", "@Pned rolled a 5.", "@Pned wins the game."],
    }
    for name, lines in said.items():
        (tmp_path / f"Match_GameLog_{name}.dat").write_bytes(b"\x01\xfe".join(line.encode("latin-1") for line in lines))
    read = {r.match_id: r for r in matchlogs.records(matchlogs.scan(spark, str(tmp_path))).collect()}
    whole = read["b-7"]
    assert (whole.players, whole.winner, whole.score, whole.game_wins) == (["kay_9", "Lev-2"], "Lev-2", "2-1", {"Lev-2": 2, "kay_9": 1})
    assert whole.cards == {"Lev-2": ["Oak", "Elm"]}
    assert (read["b-8"].winner, read["b-8"].score, read["b-8"].cards) == ("mo", None, {"mo": ["Ash"]})
    assert read["b-9"].winner is None
    told = spark.createDataFrame([(["mo", "ned"], "ned"), (["ned", "o"], "o"), (["ned", "p"], "ned")], "players array<string>, winner string")
    assert tuple(matchlogs.match_record(told, "ned").first()) == (2, 1)


def test_weekly_averages_and_the_dense_table(spark, tmp_path):
    cfg = replace(CFG, mover_threshold=0.5)
    rows = []
    def put(n, day, split, other, copies):  # noqa: E306
        cards = {cfg.panel_split_item: split, cfg.panel_other_item: other, "Moves": copies, "Ground": 20}
        rows.extend((n, date.fromisoformat(day), "challenge-class", True, item, q, 0) for item, q in cards.items() if q)
    put(1, "2026-06-01", 0, 4, 2), put(2, "2026-06-07", 0, 3, 0), put(3, "2026-06-10", 4, 0, 0)
    put(4, "2026-06-13", 0, 0, 1), put(5, "2026-06-14", 0, 4, 0), put(6, "2026-06-15", 0, 4, 4)
    items = spark.createDataFrame(rows, "list_id bigint, date date, stratum string, member boolean, item string, qty_a int, qty_b int")
    lists = items.select("list_id", "date", "stratum", "member").distinct()
    binned = weekly.binned_lists(items, lists, cfg).cache()
    assert {r.dropped: r.lists for r in weekly.dropped_lists(binned).collect()} == {"incomplete final week": 1, "neither build": 1}
    typed = spark.createDataFrame([("Ground",)], "item string")
    averages = weekly.weekly_averages(items, binned, typed, cfg).cache()
    one = {(str(r.week), r.item): r.avg_copies for r in averages.where("board = 'mainboard' AND panel = \"Riddler Goryo's\"").collect()}
    assert one["2026-06-07", "Moves"] == 1.0 and ("2026-06-14", "Moves") not in one
    weeks = weekly.panel_weeks(binned)
    kept = weekly.movers(averages, weeks, cfg)
    assert "Moves" in {r.item for r in kept.collect()}
    dense = weekly.densify(averages, weeks, kept)
    cell = dense.where("item = 'Moves' AND board = 'mainboard' AND week = '2026-06-14'").collect()
    assert {(r.panel, r.avg_copies, r.highlight) for r in cell} == {("Riddler Goryo's", 0.0, True), ("Fallaji Goryo's", 0.0, True)}
    assert dense.count() == 3 * 2 * 3


def test_the_arrivals_stream_drops_an_event_landing_twice(spark, folder, tmp_path):
    lists = arrivals.arriving_lists(arrivals.read_landing(spark, folder, files_per_trigger=1))
    landed = arrivals.land(lists, str(tmp_path / "out"), str(tmp_path / "state"))
    assert landed.count() == 6 == landed.select("event_id", "pos").distinct().count()


def test_a_broken_payload_is_quarantined_and_the_next_file_of_its_event_stands(spark, tmp_path):
    land(spark, tmp_path, league("2026-06-02", ("amy", ""), ("bea", "Marsh 17/4")))
    (whole,) = tmp_path.glob("*.json")
    (tmp_path / "a-first.json").write_text(whole.read_text()[:-20])
    (tmp_path / "b-empty.json").write_text("")
    assert {r.actor for r in payload.baskets(payload.first_copies(payload.scan(spark, str(tmp_path)))).collect()} == {"amy", "bea"}
    held = {r.path.rsplit("/", 1)[-1]: r.value for r in payload.quarantine(spark, str(tmp_path)).collect()}
    assert held.get("a-first.json") == whole.read_text()[:-20] and whole.name not in held


def test_landed_lines_are_scanned_and_broken_lines_held_back(spark, tmp_path):
    land(spark, tmp_path, league("2026-06-02", ("amy", "")))
    (whole,) = tmp_path.glob("*.json")
    line = json.dumps(json.loads(whole.read_text()))
    feeds = str(tmp_path / "feeds")
    spark.createDataFrame([("one", line[:-9]), ("two", line)], "feed string, value string").write.partitionBy("feed").text(feeds)
    (row,) = payload.first_copies(payload.scan(spark, feeds, lines=True)).collect()
    assert "/feed=two/" in row.path and len(row.decklists) == 1
    (held,) = payload.quarantine(spark, feeds, lines=True).collect()
    assert "/feed=one/" in held.path and held.value == line[:-9]


@pytest.mark.parametrize("turns", [1, 3, 64])
def test_a_log_landed_in_pieces_reads_as_one(spark, tmp_path, turns):
    said = ["@Pmo rolled a 2.", "@Pned rolled a 5.", "@Pmo casts @[Ash@:1,1:@].", "@Pned wins the game.", "@Pmo wins the game.",
            "@Pned casts @[Élan vital@:1,1:@].", "@Pned wins the game.", "@Pmo casts @[Ash@:1,2:@] @Pmo casts @[Elm@:1,1:@]."]
    logs = spark.createDataFrame([("7", n, text) for n, text in enumerate(said)] + [("8", 0, "@Pmo rolled a 1.")], "match_id string, part long, value string")
    matchlogs.land(logs, str(tmp_path / "logs"), turns)
    scanned = matchlogs.scan(spark, str(tmp_path / "logs"), "UTF-8")
    assert scanned.where("match_id = '7'").count() == -(-len(said) // turns)
    read = {r.match_id: r for r in matchlogs.records(scanned).collect()}
    assert (read["7"].players, read["7"].winner, read["7"].game_wins) == (["mo", "ned"], "ned", {"mo": 1, "ned": 2})
    assert read["7"].cards == {"mo": ["Ash", "Elm"], "ned": ["Élan vital"]}
    assert read["8"].players == ["mo"] and read["8"].winner is None


# ---- Landed payloads ------------------------------------------------------------------


def test_landed_payloads_are_packed_and_read_back_without_their_cards(spark, monkeypatch):
    """Payload texts repeat themselves: what lies on disk and what tells copies apart is a small part of them."""
    deck = lambda who: {"loginid": who, "player": who, "main_deck": [{"qty": "1", "card_attributes": {"card_name": "Kite", "card_type": "SPELL"}}] * 200,
                        "sideboard_deck": [], "wins": {"wins": "5", "losses": "0"}}
    said = {f"modern-league-2026-06-01{n}": json.dumps({"site_name": f"modern-league-2026-06-01{n}", "name": "A league", "publish_date": "2026-06-01", "decklists": [deck(f"a{n}")]}) for n in range(30)}
    rows = [(feed, "P" if n % 3 == 0 else "F", text) for feed in ("one", "two") for n, text in enumerate(said.values())]
    monkeypatch.setattr(derived, "documents", lambda run: spark.createDataFrame(rows, "feed string, fill string, value string").coalesce(1))
    run = SimpleNamespace(spark=spark)
    run.landing = derived.land_payloads(run)
    stored = sum(p.stat().st_size for p in Path(run.landing).glob("feed=*/part-*"))
    assert stored < sum(len(text) for _, _, text in rows) / 10
    assert payload.quarantine(spark, run.landing, lines=True).count() == 10
    read = derived.payloads(run)
    assert "main_deck" not in read.schema["decklists"].simpleString()
    whole = payload.first_copies(payload.scan(spark, run.landing, lines=True))
    assert sorted(payload.baskets(read).collect()) == sorted(payload.baskets(whole).collect())
    assert {(r.event_id, r.actor, r.record) for r in payload.baskets(read).collect()} == {(name, f"a{n}", "5-0") for n, name in enumerate(said)}


def test_streamed_payloads_land_packed_and_each_is_parsed_once(spark, tmp_path, monkeypatch):
    card = {"qty": "1", "card_attributes": {"card_name": "Kite", "card_type": "SPELL"}}
    text = lambda n: json.dumps({"site_name": f"modern-league-2026-06-01{n}", "name": "A league", "publish_date": "2026-06-01",
                                 "decklists": [{"loginid": f"a{n}", "player": f"a{n}", "main_deck": [card] * 200, "sideboard_deck": [], "wins": None}]})
    said = [text(n) for n in range(30)]
    monkeypatch.setattr(derived, "documents", lambda run: spark.createDataFrame([(t,) for t in said * 2], "value string").coalesce(1))
    monkeypatch.setattr(derived, "fresh_path", lambda spark, name: str(tmp_path / name))
    kept = []
    monkeypatch.setattr(arrivals, "settled", lambda frame, name: kept.append(name) or settled(frame, name))
    found = derived.streamed_arrivals(SimpleNamespace(spark=spark, cfg=CFG))
    assert {tuple(r) for r in found.collect()} == {(f"modern-league-2026-06-01{n}", "league", f"a{n}", date(2026, 6, 1)) for n in range(30)}
    assert kept == ["arrived"]
    assert sum(p.stat().st_size for p in (tmp_path / "arrivals/landing").glob("part-*")) < sum(map(len, said)) / 10


def test_many_logs_land_in_few_files(spark, tmp_path):
    logs = spark.range(300).selectExpr("hex(id) AS match_id", "0L AS part", "'@Pmo rolled a 2.' AS value").selectExpr("lower(match_id) AS match_id", "part", "value")
    nameless = spark.createDataFrame([(None, 0, "x"), ("7", None, "x")], "match_id string, part long, value string")
    matchlogs.land(logs.union(nameless), str(tmp_path / "logs"))
    assert len([p for p in (tmp_path / "logs").rglob("part-*") if p.is_file()]) <= 16
    read = matchlogs.scan(spark, str(tmp_path / "logs"), "UTF-8")
    assert read.count() == 300 == read.select("match_id").distinct().count()


def test_the_store_moves_a_row_a_list(spark, tmp_path):
    """The two tables come out of one with a list's items in its row, equal to items joined to their lists."""
    lists = spark.createDataFrame([(1, "x", "e", "one", "league", date(2026, 6, 1), None, 3, None), (1, "y", "e", "one", "league", date(2026, 7, 1), None, 6, None),
                                   (2, "x", "e", "two", "league", None, None, None, None), (None, "z", "e", "two", "league", date(2026, 6, 1), None, None, None)],
                                  "list_id bigint, actor string, event string, event_id string, event_class string, date date, placement int, points int, record string")
    entries = spark.createDataFrame([(n, "a", 2, card, "LAND") for n in (1, 3, None) for card in (*CFG.signature, "Kite", "Kite", None)], "list_id bigint, board string, qty int, name string, type string")
    none = spark.createDataFrame([], "captured_on date, window_days int, cohort string, share double, deck_count int")
    made = stores.build(lists, entries, none, CFG, str(tmp_path))
    counted = stores.count_items(entries, CFG)
    listed = scope.classify(lists, counted, CFG)
    rows = lambda frame: sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    assert rows(made.baskets) == rows(listed)
    assert rows(made.items) == rows(scope.attach(counted.drop("typed_a"), listed))
    assert spark.read.parquet(str(tmp_path / "lists")).count() == 4
