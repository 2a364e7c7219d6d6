"""One statement per registered query, over the shared expressions of `base`."""

import re

from .base import C, CUT, EPOCH, FLAG_COLUMNS, HIST, T, W, lacking, query

READ = "fresh_adoption fresh_weighted fresh_tilt baseline_adoption baseline_weighted baseline_tilt delta"
HYPE_F = "from_adoption to_adoption tilt challenge_before league_after challenge_after tilt_after now_adoption"
FLAG_F = HYPE_F + " historical_adoption"
SLOT_F = "confidence tilt delta segment_playing lead_adoption lead_tilt lead_delta"
CHANGES = """
SELECT owner, 1 AS from_version, 2 AS to_version, coalesce(a.item, b.item) AS item, a.qty_a AS before_a, a.qty_b AS before_b, b.qty_a AS after_a, b.qty_b AS after_b
FROM (SELECT * FROM c_ref WHERE version = 1 AND qty_a + qty_b > 0 AND owner IN (SELECT owner FROM c_ref WHERE version = 2)) a
FULL OUTER JOIN (SELECT * FROM c_ref WHERE version = 2 AND qty_a + qty_b > 0) b USING (owner, item)
WHERE a.qty_a IS DISTINCT FROM b.qty_a OR a.qty_b IS DISTINCT FROM b.qty_b"""
GAP = f"""
SELECT *, CASE WHEN gap IS NULL OR uncapped IS NULL THEN NULL WHEN gap * uncapped < 0 THEN 'flips' WHEN abs(gap) < {C.cap_collapse} * abs(uncapped) THEN 'collapses' ELSE 'holds' END AS cap_effect
FROM (SELECT regime, segment, la AS league_actors, ca AS challenge_actors,
    la / nullif(sum(la) OVER (PARTITION BY regime), 0) AS league_share, ca / nullif(sum(ca) OVER (PARTITION BY regime), 0) AS challenge_share,
    la / nullif(sum(la) OVER (PARTITION BY regime), 0) - ca / nullif(sum(ca) OVER (PARTITION BY regime), 0) AS gap,
    ll / nullif(sum(ll) OVER (PARTITION BY regime), 0) - cl / nullif(sum(cl) OVER (PARTITION BY regime), 0) AS uncapped
  FROM (SELECT CASE WHEN date >= {EPOCH} THEN 'post-regime' ELSE 'pre-regime' END AS regime, segment,
      count(DISTINCT actor) FILTER (stratum = 'league') AS la, count(DISTINCT actor) FILTER (stratum <> 'league') AS ca,
      count(*) FILTER (stratum = 'league') AS ll, count(*) FILTER (stratum <> 'league') AS cl
    FROM c_lists WHERE member GROUP BY 1, 2))"""
RATIO = """
SELECT date, stratum, segment, count(*) AS lists, count(*) / sum(count(*)) OVER (PARTITION BY date, stratum) AS share
FROM c_lists WHERE member GROUP BY 1, 2, 3"""
MIG = f"""
SELECT *, CASE WHEN shift >= {C.board_shift} THEN 'to main' WHEN shift <= -{C.board_shift} THEN 'to side' ELSE 'steady' END AS direction FROM (
  SELECT *, fresh_main_copies / nullif(fresh_main_copies + fresh_side_copies, 0) AS fresh_main_share,
    baseline_main_copies / nullif(baseline_main_copies + baseline_side_copies, 0) AS baseline_main_share,
    fresh_main_copies / nullif(fresh_main_copies + fresh_side_copies, 0) - baseline_main_copies / nullif(baseline_main_copies + baseline_side_copies, 0) AS shift
  FROM (SELECT segment, stratum, item, CAST(sum(fresh_lists) AS BIGINT) AS fresh_lists, max(fresh_population) AS fresh_population,
      CAST(sum(qty_a * fresh_lists) AS BIGINT) AS fresh_main_copies, CAST(sum(qty_b * fresh_lists) AS BIGINT) AS fresh_side_copies,
      CAST(sum(baseline_lists) AS BIGINT) AS baseline_lists, max(baseline_population) AS baseline_population,
      CAST(sum(qty_a * baseline_lists) AS BIGINT) AS baseline_main_copies, CAST(sum(qty_b * baseline_lists) AS BIGINT) AS baseline_side_copies
    FROM c_adoption GROUP BY 1, 2, 3))"""
SUBS = """
SELECT segment, stratum, target, target_a, target_b, item, coalesce(n, 0) / on_n AS on_it, (lists - coalesce(n, 0)) / (pop - on_n) AS elsewhere,
  on_n AS on_it_lists, pop - on_n AS elsewhere_lists, (lists - coalesce(n, 0)) / (pop - on_n) - coalesce(n, 0) / on_n AS difference
FROM (SELECT segment, stratum, item AS target, qty_a AS target_a, qty_b AS target_b, count(*) AS on_n FROM c_scopei WHERE fresh GROUP BY ALL) h
JOIN (SELECT segment, stratum, count(*) AS pop FROM c_scope WHERE fresh GROUP BY ALL) USING (segment, stratum)
JOIN (SELECT segment, stratum, item, count(*) AS lists FROM c_scopei WHERE fresh GROUP BY ALL) USING (segment, stratum)
LEFT JOIN (SELECT a.segment, a.stratum, a.item AS target, a.qty_a AS target_a, a.qty_b AS target_b, b.item, count(*) AS n
  FROM c_scopei a JOIN c_scopei b USING (list_id) WHERE a.fresh GROUP BY ALL) USING (segment, stratum, target, target_a, target_b, item)
WHERE pop > on_n"""
CLIMB = """
SELECT segment, stratum, item, sum(delta) AS delta, sum(fresh_lists) / max(fresh_population) AS adoption,
  arg_max(qty_a, (fresh_lists, -qty_a, -qty_b)) AS lead_a, arg_max(qty_b, (fresh_lists, -qty_a, -qty_b)) AS lead_b,
  arg_max(fresh_adoption, (fresh_lists, -qty_a, -qty_b)) AS lead_adoption, max(fresh_population) AS population
FROM c_adoption SEMI JOIN c_fringe USING (segment, item) WHERE fresh_lists > 0 AND delta > 0 GROUP BY 1, 2, 3"""
INDEX = """CAST(date AS VARCHAR) AS date, event_id, event_class, actor, coalesce(CAST(placement AS VARCHAR), '') AS placement, coalesce(CAST(points AS VARCHAR), '') AS points"""
BEFORE = f"SELECT {INDEX} FROM c_lists WHERE status IN ('F', 'P')"
AFTER = f"SELECT {INDEX} FROM c_lists WHERE status IN ('O', 'P')"
ADDED = f"({AFTER} EXCEPT ALL {BEFORE})"
GONE = f"({BEFORE} EXCEPT ALL {AFTER})"
ARRIVED = f"""SELECT list_id, date, event_id, event, actor, placement, segment FROM c_lists l
WHERE member AND EXISTS (SELECT 1 FROM {ADDED} x WHERE x.date = CAST(l.date AS VARCHAR) AND x.event_id = l.event_id AND x.actor = l.actor)"""
FINISH = "CASE WHEN placement IS NOT NULL THEN '#' || placement ELSE coalesce(record, '5-0') END"
NEAR = f"""SELECT list_id, actor, event, event_id, event_class, date, placement, points, record, {FINISH} AS finish, kept,
  CASE WHEN kept = 'type:ECONOMY' THEN 'type:STANDARD' ELSE '' END AS dropped
FROM c_lists JOIN (SELECT list_id, string_agg(item, ',' ORDER BY item) AS kept FROM c_items0 WHERE item IN ('type:ECONOMY', 'type:STANDARD') GROUP BY 1) USING (list_id)
WHERE near_miss"""
SERIES = """SELECT l.list_id, l.actor, l.event, l.segment, l.member, l.stratum, l.date, l.placement, l.weight, q.configurations
FROM c_lists l JOIN (SELECT list_id, string_agg(item || '|' || qty_a || '|' || qty_b, ';' ORDER BY item) AS configurations FROM c_items0 GROUP BY 1) q USING (list_id)"""
SITE = "'basket-' || CASE WHEN event_class = 'league' THEN 'league' ELSE lower(priority) END || '-' || CAST(date AS VARCHAR) || list_id"
CLOCK = f"""
SELECT *, answerable_on > DATE '{C.deadline}' AS past_deadline, kind = 'hype' AND state = 'matured' AS waiting_on_evidence FROM (
  SELECT kind, segment, item, qty_a, qty_b, raised_on, actor, event, date, state,
    CASE WHEN kind = 'hype' AND state = 'raised' THEN CAST(raised_on + 6 AS DATE)
         WHEN kind = 'breakthrough' AND state = 'watching' THEN date + {T} END AS answerable_on
  FROM c_ledger WHERE kind IN ('hype', 'breakthrough'))"""
CONV_LOG = """
SELECT CAST(conv_id AS VARCHAR) AS match_id, turn AS part, role AS player, length(text) > 200 AS won, role = 'system' AS told,
  regexp_extract_all(text, '[^\\x00-\\x20@]+') AS cards FROM conversations"""
MATCHES = f"""
SELECT m.match_id, p.players, coalesce(x.explicit, s.inferred) AS winner, x.score FROM (SELECT DISTINCT match_id FROM ({CONV_LOG})) m
LEFT JOIN (SELECT match_id, string_agg(player, ',' ORDER BY part) AS players FROM (SELECT match_id, player, min(part) AS part FROM ({CONV_LOG}) GROUP BY 1, 2) GROUP BY 1) p USING (match_id)
LEFT JOIN (SELECT DISTINCT match_id, 'system' AS explicit, '2-1' AS score FROM ({CONV_LOG}) WHERE told) x USING (match_id)
LEFT JOIN (SELECT match_id, arg_min(player, part) AS inferred FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, player ORDER BY part) AS nth FROM ({CONV_LOG}) WHERE won) WHERE nth = 2 GROUP BY 1) s USING (match_id)"""
SLOTS = "SELECT * FROM c_slots"
NEWEST = "(SELECT owner, max(version) AS version FROM c_ref GROUP BY 1)"
DENSE = """
SELECT p.week, p.panel, g.board, g.item, coalesce(a.avg_copies, 0.0) AS avg_copies, p.lists, g.item IN (SELECT item FROM c_movers) AS highlight
FROM (SELECT DISTINCT item, unnest(['mainboard', 'sideboard']) AS board FROM (SELECT DISTINCT item FROM c_wavg)) g CROSS JOIN c_pw p
LEFT JOIN c_wavg a ON a.panel = p.panel AND a.week = p.week AND a.board = g.board AND a.item = g.item"""
TRAILING = f"""
SELECT segment, item, qty_a, qty_b, e AS "end", stratum, lists, population, lists / population AS adoption FROM (
  SELECT *, unnest(['league', 'challenge-class']) AS stratum, unnest([know_l, know_c]) AS lists, unnest([pnow_l, pnow_c]) AS population
  FROM c_hkey JOIN c_hpop USING (segment, e)) WHERE lists > 0"""

ORACLES: dict[str, str] = {
    "s1_event_scan": query(f"SELECT {SITE} AS site_name, 'one/' || {SITE} AS path, 1 AS lists FROM c_lists"),
    "s2_event_flatten": query(f"""SELECT actor, event, {SITE} AS event_id, CASE WHEN event_class = 'league' THEN 'league' ELSE lower(priority) END AS event_class, date,
      CAST(placement + CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS INTEGER) AS placement, points,
      CASE WHEN event_class = 'league' THEN '5-0' ELSE CAST(floor(points / 3) AS INTEGER) || '-0' END AS record FROM c_lists"""),
    "s3_finish_resolution": query(f"""SELECT {SITE} AS event_id, actor AS loginid, CAST(placement + CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS INTEGER) AS placement
      FROM c_lists WHERE event_class <> 'league'"""),
    "s4_event_class": query("SELECT list_id, CASE WHEN event_class = 'league' THEN 'league' ELSE lower(priority) END AS event_class FROM c_lists"),
    "s5_item_counts": query("""SELECT list_id, CASE WHEN name = 'brand:Brand#25' THEN 'brand:Brand#24' ELSE name END AS item,
      CAST(count(*) FILTER (board = 'a') AS INTEGER) AS qty_a, CAST(count(*) FILTER (board = 'b') AS INTEGER) AS qty_b FROM c_entries GROUP BY 1, 2"""),
    "s6_typed_totals": query("SELECT * FROM c_totals"),
    "s7_store": query("SELECT list_id, actor, event, event_id, event_class, date, placement, points, record, typed_total, cohort, segment FROM c_lists"),
    "s8_item_rows": query("SELECT list_id, item, qty_a, qty_b FROM c_items0"),
    "s9_share_snapshots": query("SELECT day AS captured_on, 1 AS window_days, cohort, count(*) / 100 AS share, count(*) AS deck_count FROM c_ev GROUP BY 1, 3", "share"),
    "s10_snapshot_ingest": query("""SELECT '2024-01-30' AS captured_on, '30' AS window_days, event_type AS archetype, CAST(count(*) AS VARCHAR) AS meta_pct, CAST(count(*) AS VARCHAR) AS deck_count
      FROM events GROUP BY 3"""),
    "s11_index": query(f"SELECT {INDEX} FROM c_lists"),
    "s12_refresh": query(f"""SELECT event_id, date, count(*) AS lists FROM c_lists, (SELECT max(date) AS today FROM c_lists)
      WHERE date >= today - {C.unsettled_days} OR event_class <> 'league' GROUP BY 1, 2"""),
    "s12_refreshed_store": query(f"""SELECT * FROM (WITH days AS (SELECT *, date >= (SELECT max(date) FROM c_lists) - {C.unsettled_days} AS late, event_id = (SELECT min(event_id) FROM c_lists) AS missed FROM c_lists),
      texts AS (SELECT CAST(date AS VARCHAR) AS date, event_id, event_class, actor, coalesce(CAST(placement AS VARCHAR), '') AS placement, coalesce(CAST(points AS VARCHAR), '') AS points,
        CASE WHEN late THEN event_class <> '1-URGENT' ELSE NOT missed END AS old, CASE WHEN late THEN event_class <> '2-HIGH' ELSE true END AS new FROM days),
      before AS (SELECT * EXCLUDE (old, new) FROM texts WHERE old), after AS (SELECT * EXCLUDE (old, new) FROM texts WHERE new)
      SELECT *, 'added' AS part FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before)
      UNION ALL SELECT *, 'withdrawn' FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after) UNION ALL SELECT *, 'held' FROM after)"""),
    "s12_refreshed_tallies": query("""SELECT segment, item, qty_a, qty_b, date, count(*) FILTER (stratum = 'league') AS league, count(*) FILTER (stratum <> 'league') AS challenge,
      coalesce(sum(weight) FILTER (stratum <> 'league'), 0.0) AS weight, min(placement) FILTER (stratum <> 'league') * 1000000 + CAST(date - DATE '1970-01-01' AS BIGINT) AS best
      FROM n_items WHERE member GROUP BY 1, 2, 3, 4, 5""", "weight"),
    "s12_refreshed_baskets": query("SELECT list_id, event_id, date, member, segment, weight FROM n_lists", "weight"),
    "s12_refreshed_adoption": query("SELECT * FROM n_adoption", READ),
    "s12_refreshed_sliding": query(re.sub(r"\bc_", "n_", TRAILING), "adoption"),
    "s13_typed_items": query("SELECT * FROM c_typed"),
    "s1_quarantine": query(f"SELECT 'two' AS feed, {SITE} AS site_name FROM c_lists WHERE status = 'P'"),
    "s14_reference_captures": query("SELECT owner, version, replace(item, '#', '-') AS item, qty_a, qty_b, override, note FROM c_ref"),
    "s15_match_records": query(MATCHES),
    "s15_game_wins": query(f"SELECT match_id, player, count(*) AS wins FROM ({CONV_LOG}) WHERE won GROUP BY 1, 2"),
    "s15_cards_seen": query(f"SELECT DISTINCT match_id, player, unnest(cards) AS card FROM ({CONV_LOG})"),
    "s17_weekly_sink": query(DENSE, "avg_copies"),
    "s18_ledger_store": query(f"SELECT {FLAG_COLUMNS}, {CUT} AS first_seen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_id) AS rn FROM k_flags) WHERE rn = 1", FLAG_F),
    "p1_cohort": query("SELECT list_id, cohort FROM c_lists"),
    "p2_segment": query("SELECT list_id, segment FROM c_lists WHERE member"),
    "p3_stratum": query("SELECT list_id, stratum FROM c_lists"),
    "p4_epoch": query(f"SELECT list_id, CASE WHEN date >= {EPOCH} THEN 'post-regime' ELSE 'pre-regime' END AS regime FROM c_lists"),
    "p5_window_scope": query("SELECT list_id, segment, stratum, weight, typed_total, CASE WHEN fresh THEN 'fresh' ELSE 'baseline' END AS \"window\" FROM c_scope", "weight"),
    "p6_cohort_lists": query(f"SELECT list_id, actor, event, event_id, event_class, date, placement, points, record, segment, {FINISH} AS finish FROM c_lists WHERE member"),
    "p7_item_configurations": query("SELECT list_id, actor, event_id, date, segment, item, qty_a, qty_b, qty_a + qty_b AS total FROM c_items WHERE member"),
    "p8_item_pool": query("SELECT DISTINCT item FROM c_items WHERE member"),
    "p9_near_miss": query(f"SELECT list_id, kept FROM ({NEAR})"),
    "p10_near_miss_lists": query(NEAR),
    "p11_panels": query(f"""SELECT w.list_id, panel FROM c_wl w WHERE EXISTS (SELECT 1 FROM c_items0 i WHERE i.list_id = w.list_id AND i.item IN ('{C.panel_split_item}', '{C.panel_other_item}'))"""),
    "p12_alias": query("SELECT DISTINCT item, CASE WHEN item = 'brand:Brand#25' THEN 'brand:Brand#24' ELSE item END AS resolved FROM c_items0"),
    "p13_arm_rows": query("SELECT item, arm, count(*) AS rows FROM (SELECT item, qty_a, qty_b, unnest(['any count', 'board a', 'board b', qty_a || '/' || qty_b]) AS arm FROM c_items WHERE member) WHERE (arm <> 'board a' OR qty_a > 0) AND (arm <> 'board b' OR qty_b > 0) GROUP BY 1, 2"),
    "p14_tilt_floor": query(f"SELECT segment, stratum, item, qty_a, qty_b, CASE WHEN abs(fresh_tilt) >= {C.tilt_floor} THEN fresh_tilt END AS tilt_shown FROM c_adoption", "tilt_shown"),
    "p15_finished": query(f"SELECT list_id, stratum = 'league' OR placement <= {C.departure_placement} AS finished FROM c_lists"),
    "p16_finish_label": query(f"SELECT list_id, {FINISH} AS finish FROM c_lists"),
    "j1_items_lists": query("SELECT list_id, item, qty_a, qty_b, actor, date, segment FROM c_items WHERE member"),
    "j2_arrivals": query(ARRIVED),
    "j3_share_as_of": query("""SELECT day, captured_on, window_days, share, deck_count FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) ASOF LEFT JOIN c_trend ON day >= captured_on""", "share"),
    "j4_series": query(f"{SERIES} WHERE l.member AND l.date >= {EPOCH}", "weight"),
    "j5_near_miss_series": query(f"{SERIES} WHERE l.near_miss AND l.date >= {EPOCH}", "weight"),
    "j6_arm_flags": query("SELECT list_id, segment, stratum, actor, placement, item, arm FROM (SELECT *, unnest(['any count', 'board a', 'board b', qty_a || '/' || qty_b]) AS arm FROM c_memi) WHERE (arm <> 'board a' OR qty_a > 0) AND (arm <> 'board b' OR qty_b > 0)"),
    "j7_lineage_spread": query("SELECT segment, actor, event, date, spread_item, spiked_on, resolved, standing FROM c_lineage WHERE spread_item IS NOT NULL"),
    "j8_followers": query("SELECT DISTINCT f.date, f.item, f.follower, f.taken_up FROM c_fol f JOIN c_brk b ON b.list_id = f.list_id AND b.adopted_item = f.item"),
    "j9_slot_adoption": query("SELECT owner, version, segment, item, qty_a, qty_b, population, lists, confidence, segment_playing, lead_a, lead_b, lead_adoption, lead_delta FROM c_slots",
                              "confidence segment_playing lead_adoption lead_delta"),
    "j10_missing_core": query("SELECT * FROM c_missing", SLOT_F),
    "j11_unplayed": query("SELECT * FROM c_unplayed", "segment_playing lead_adoption lead_delta confidence"),
    "j12_changes": query(CHANGES),
    "j13_history": query(f"SELECT owner, from_version, to_version, count(*) AS changed FROM ({CHANGES}) GROUP BY 1, 2, 3"),
    "j14_subject_readings": query("SELECT * FROM c_spoken", "adoption tilt delta"),
    "j15_quiet_subjects": query("""SELECT hypothesis_id, subject, segment, CASE WHEN subject = 'lands' OR subject IN (SELECT item FROM c_items WHERE member) THEN 'silent' ELSE 'unknown' END AS reading
      FROM c_subj s, (SELECT unnest(['with', 'without', 'hybrid']) AS segment) g
      WHERE NOT EXISTS (SELECT 1 FROM c_spoken p WHERE p.hypothesis_id = s.hypothesis_id AND p.subject = s.subject AND p.segment = g.segment)"""),
    "j16_subject_flags": query("""SELECT hypothesis_id, subject, segment, kind, qty_a || '/' || qty_b AS configuration, state, first_seen AS raised,
      CASE WHEN kind = 'hype' THEN 'adoption behind a hyped finish is not evidence about the item' END AS caveat
      FROM c_subj JOIN c_ledger ON item = subject"""),
    "j17_densify": query(DENSE, "avg_copies"),
    "a1_windows": query("SELECT * FROM c_bounds"),
    "a2_populations": query("""SELECT segment, stratum, fp AS fresh_population, bp AS baseline_population, fpw AS fresh_population_weight, bpw AS baseline_population_weight FROM c_pops""",
                            "fresh_population_weight baseline_population_weight"),
    "a3_adoption": query("SELECT * FROM c_adoption", READ),
    "a4_totals": query("SELECT * FROM c_landtab", READ),
    "a5_conversion_gap": query(GAP, "league_share challenge_share gap uncapped"),
    "a6_cap_effect": query(f"SELECT regime, segment, cap_effect FROM ({GAP})"),
    "a7_segment_ratio": query(RATIO, "share"),
    "a8_sliding_adoption": query(TRAILING, "adoption"),
    "a9_share_trend": query("SELECT captured_on, window_days, share, deck_count FROM c_trend", "share"),
    "a10_item_rollup": query("SELECT * FROM c_byitem", "segment_playing lead_adoption lead_tilt lead_delta"),
    "a11_migration": query(MIG, "fresh_main_share baseline_main_share shift"),
    "a12_migrations": query(f"SELECT * FROM ({MIG}) WHERE direction <> 'steady' AND least(fresh_lists, baseline_lists) >= {C.migration_min_lists}", "fresh_main_share baseline_main_share shift"),
    "a13_substitution": query(SUBS, "on_it elsewhere difference"),
    "a14_climbing": query(CLIMB, "delta adoption lead_adoption"),
    "a15_proven_actors": query("SELECT * FROM c_proven"),
    "a16_contrast": query("SELECT segment, item, arm, with_lists, with_made, with_rate, without_lists, without_made, without_rate, difference, p, floor, state FROM c_contrast",
                          "with_rate without_rate difference p floor"),
    "a17_fisher": query("SELECT segment, item, arm, p FROM c_contrast", "p"),
    "a18_detection_floor": query("SELECT segment, item, arm, floor FROM c_contrast", "floor"),
    "a19_conversion": query("SELECT segment, item, arm, league_actors, challenge_actors, league_share, challenge_share, gap, uncapped, cap_effect FROM c_contrast",
                            "league_share challenge_share gap uncapped"),
    "a20_weekly_averages": query("SELECT * FROM c_wavg", "avg_copies"),
    "a21_movers": query("SELECT * FROM c_movers", "swing"),
    "a22_dropped_lists": query("SELECT dropped, count(*) AS lists FROM c_bin WHERE dropped IS NOT NULL GROUP BY 1"),
    "a23_match_record": query(f"""SELECT count(*) FILTER (winner = 'user') AS wins, count(*) FILTER (winner <> 'user') AS losses FROM ({MATCHES})
      WHERE winner IS NOT NULL AND list_contains(string_split(players, ','), 'user')"""),
    "a24_follower_bar": query("SELECT * FROM c_bar"),
    "a25_ingest_summary": query(f"""SELECT (SELECT count(*) FROM {ADDED}) AS added, (SELECT count(DISTINCT event_id) FROM {ADDED}) AS events,
      (SELECT count(*) FROM ({ARRIVED})) AS cohort_added, (SELECT count(*) FROM {GONE}) AS withdrawn"""),
    "w1_finish_weight": query("SELECT list_id, event_id, weight FROM c_lists", "weight"),
    "w2_day_share": query(f"SELECT date, stratum, segment, share FROM ({RATIO})", "share"),
    "w3_novelty": query('''SELECT item, date, plays_before, CAST(lists_before AS BIGINT) AS lists_before, historical_adoption, "returning", absent_days, fringe FROM c_novel''', "historical_adoption"),
    "w4_first_appearance": query("SELECT segment, item, appeared_on, actor FROM c_fringe"),
    "w5_origin_finish": query("SELECT segment, item, qty_a, qty_b, e AS \"end\", origin_actor, origin_date, origin_placement FROM c_spk"),
    "w6_episodes": query("SELECT segment, item, qty_a, qty_b, e AS \"end\", to_adoption FROM c_acc JOIN c_spk USING (segment, item, qty_a, qty_b, e)", "to_adoption"),
    "w6_refreshed_episodes": query("SELECT segment, item, qty_a, qty_b, e AS \"end\", to_adoption FROM n_acc JOIN n_spk USING (segment, item, qty_a, qty_b, e)", "to_adoption"),
    "w7_as_of_tally": query("""SELECT against, stratum, item, date, count(*) FILTER (own) AS plays, min(plays_before) AS plays_before
      FROM c_seeni JOIN c_spine USING (against, stratum, item, date) GROUP BY 1, 2, 3, 4"""),
    "w8_debuts": query("SELECT * FROM c_debut"),
    "w9_cut_count": query(f"""SELECT owner, version, item, rank, CASE WHEN rank = 1 THEN greatest(0, found - 3) ELSE 0 END AS dropped FROM (
      SELECT *, row_number() OVER (PARTITION BY owner, version ORDER BY playing_lists DESC, item) AS rank, count(*) OVER (PARTITION BY owner, version) AS found FROM ({lacking(0.1)})) WHERE rank <= 3"""),
    "t1_playtest_queue": query("SELECT * FROM c_queue", SLOT_F),
    "t2_unplayed_top": query(f"""SELECT owner, version, rank, item, segment_playing, CASE WHEN rank = 1 THEN greatest(0, found - {C.unplayed_limit}) ELSE 0 END AS dropped
      FROM c_unplayed WHERE rank <= {C.unplayed_limit}""", "segment_playing"),
    "t3_substitution_ends": query(f"""SELECT *, 0 AS left_out FROM (SELECT *, row_number() OVER (PARTITION BY segment, stratum, target, target_a, target_b ORDER BY round(difference, 9) DESC, item) AS from_top,
        row_number() OVER (PARTITION BY segment, stratum, target, target_a, target_b ORDER BY round(difference, 9), item DESC) AS from_bottom FROM ({SUBS}))""", "on_it elsewhere difference"),
    "t3_nearest_ends": query(f"""SELECT *, greatest(0, from_top + from_bottom - 7) AS left_out FROM (SELECT *, row_number() OVER (PARTITION BY segment, stratum, target, target_a, target_b ORDER BY round(difference, 9) DESC, item) AS from_top,
        row_number() OVER (PARTITION BY segment, stratum, target, target_a, target_b ORDER BY round(difference, 9), item DESC) AS from_bottom FROM ({SUBS})) WHERE least(from_top, from_bottom) <= 3""", "on_it elsewhere difference"),
    "t4_named_arrivals": query(f"SELECT *, 0 AS and_more FROM ({ARRIVED})"),
    "t5_day_order": query("SELECT list_id, date, actor FROM c_lists WHERE member"),
    "d9_index_difference": query(f"SELECT *, 'added' AS change FROM {ADDED} UNION ALL SELECT *, 'withdrawn' FROM {GONE}"),
    "u1_flag_union": query("SELECT kind, segment, count(*) AS flags FROM c_flags GROUP BY 1, 2"),
    "u2_history": query("SELECT list_id, actor, date, member, segment FROM c_hist"),
    "u3_distincts": query("SELECT 'week' AS what, CAST(week AS VARCHAR) AS value FROM c_pw UNION SELECT 'item', item FROM c_items WHERE member"),
    "d1_hype": query("SELECT * FROM c_hype", HYPE_F),
    "d1b_maturity": query("SELECT e AS \"end\" FROM c_mature"),
    "d1c_resolution": query("SELECT segment, item, qty_a, qty_b, raised_on, state, league_after, challenge_after, tilt_after, resolved_on FROM c_hype", "league_after challenge_after tilt_after"),
    "d1d_standing": query("SELECT segment, item, qty_a, qty_b, raised_on, now_adoption, standing FROM c_hype", "now_adoption"),
    "d2_fringe": query("SELECT * FROM c_fringe", "historical_adoption"),
    "d3_pet_items": query("SELECT * FROM c_pets"),
    "d4_departure": query("SELECT list_id, against, delta, novel, missing FROM c_cand"),
    "d5_segment_choice": query("SELECT list_id, against, delta FROM c_cand WHERE NOT own"),
    "d6_mode": query("SELECT list_id, mode FROM c_dep"),
    "d7_breakthroughs": query("SELECT * FROM c_brk"),
    "d8_follow_through": query("SELECT list_id, state, followers, adopted_item, needed FROM c_brk"),
    "m1_ledger": query("SELECT * FROM c_ledger", FLAG_F),
    "m2_lineage": query("SELECT * FROM c_lineage"),
    "r1_slot_audit": query(SLOTS, SLOT_F),
    "r2_clocks": query(CLOCK),
    "r3_dossier": query(f"""SELECT a.segment, a.item, a.qty_a, a.qty_b, a.fresh_lists, a.fresh_population, a.fresh_adoption, a.baseline_lists, a.baseline_population, a.baseline_adoption, a.delta,
        CASE WHEN abs(a.fresh_tilt) >= {C.tilt_floor} THEN a.fresh_tilt END AS tilt_shown, m.shift, m.direction, f.hype_flags, f.fringe_flags, f.pet_flags, f.first_seen,
        c.with_made, c.with_lists, c.without_made, c.without_lists, c.difference, c.p, c.floor, c.state, c.gap, c.uncapped, c.cap_effect
      FROM c_adoption a LEFT JOIN (SELECT * FROM ({MIG}) WHERE stratum = 'challenge-class') m USING (segment, item)
      LEFT JOIN (SELECT segment, item, count(*) FILTER (kind = 'hype') AS hype_flags, count(*) FILTER (kind = 'fringe') AS fringe_flags, count(*) FILTER (kind = 'pet-tech') AS pet_flags, min(first_seen) AS first_seen
        FROM c_ledger WHERE item IS NOT NULL GROUP BY 1, 2) f USING (segment, item)
      LEFT JOIN (SELECT * FROM c_contrast WHERE arm = 'any count') c USING (segment, item)
      WHERE a.stratum = 'challenge-class' AND a.fresh_lists + a.baseline_lists > 0""", "fresh_adoption baseline_adoption delta tilt_shown shift difference p floor gap uncapped"),
    "r4_windows": query(f"SELECT *, CAST(DATE '{C.deadline}' - as_of AS INTEGER) AS days_to_deadline FROM c_bounds"),
    "r4_audit": query(f"SELECT * FROM c_queue SEMI JOIN {NEWEST} USING (owner, version)", SLOT_F),
    "r4_audit_counts": query(f"""SELECT owner, version, count(*) FILTER (core) AS core, count(*) FILTER (NOT core AND NOT missing) AS flex, count(*) FILTER (missing) AS missing
      FROM (SELECT owner, version, core, missing FROM c_slots UNION ALL SELECT owner, version, core, missing FROM c_missing) SEMI JOIN {NEWEST} USING (owner, version) GROUP BY 1, 2"""),
    "r4_unplayed": query(f"SELECT * FROM c_unplayed SEMI JOIN {NEWEST} USING (owner, version)", "segment_playing lead_adoption lead_delta confidence"),
    "r4_climbing": query(f"SELECT * FROM ({CLIMB}) WHERE stratum = 'challenge-class'", "delta adoption lead_adoption"),
    "r4_near_misses": query(f"SELECT * FROM ({NEAR}) WHERE date >= {EPOCH}"),
    "r4_hype": query(f"""SELECT raised_on, item, qty_a, qty_b, segment, from_adoption, to_adoption, population, l.state, now_adoption, standing, origin_actor, origin_placement, origin_event, origin_date,
        answerable_on, past_deadline, waiting_on_evidence
      FROM c_ledger l JOIN (SELECT kind, segment, item, qty_a, qty_b, raised_on, answerable_on, past_deadline, waiting_on_evidence FROM ({CLOCK})) USING (kind, segment, item, qty_a, qty_b, raised_on)
      WHERE kind = 'hype'""", "from_adoption to_adoption now_adoption"),
    "r4_lineage": query(f"""SELECT *, CASE WHEN placement IS NOT NULL THEN '#' || placement ELSE '5-0' END AS finish,
        CASE WHEN followed = 'watching' THEN date + {T} END AS answerable_on, CASE WHEN followed = 'watching' THEN date + {T} > DATE '{C.deadline}' END AS past_deadline
      FROM c_lineage"""),
    "r4_ratio": query(f"SELECT date, stratum, string_agg(segment || '|' || lists, ',' ORDER BY segment) AS split FROM ({RATIO}) WHERE date >= {EPOCH} GROUP BY 1, 2"),
    "r4_trend": query("SELECT captured_on, window_days, share, deck_count FROM c_trend", "share"),
    "r5_mirror": query("""SELECT hypothesis_id, conditional_on, captured_on, window_days, share, deck_count, conditional_on IS NOT NULL AND captured_on IS NULL AS unconditioned
      FROM (SELECT DISTINCT hypothesis_id, conditional_on FROM c_subj) LEFT JOIN (SELECT * FROM c_trend ORDER BY captured_on DESC LIMIT 1) ON conditional_on = 'mirror'""", "share"),
    "st1_arrivals": query(f"SELECT {SITE} AS event_id, CASE WHEN event_class = 'league' THEN 'league' ELSE lower(priority) END AS event_class, actor, date FROM c_lists"),
    "x1_pair_crosstab": query(f"""WITH sizes AS (SELECT segment, stratum, count(*) AS population FROM c_scope WHERE fresh GROUP BY 1, 2),
      often AS (SELECT segment, stratum, item, count(*) AS lists, population FROM c_scopei JOIN sizes USING (segment, stratum) WHERE fresh GROUP BY ALL HAVING count(*) >= population * {C.pair_support}),
      pairs AS (SELECT a.segment, a.stratum, a.item, b.item AS other, count(*) AS n FROM c_scopei a JOIN c_scopei b USING (list_id) WHERE a.fresh AND a.item < b.item GROUP BY ALL)
      SELECT p.segment, p.stratum, p.item, p.other, a.population, n AS both, a.lists - n AS only_item, b.lists - n AS only_other, a.population - a.lists - b.lists + n AS neither,
        (a.population - a.lists - b.lists + 2 * n) / a.population AS diagonal, (a.lists + b.lists - 2 * n) / a.population AS opposed
      FROM pairs p JOIN often a ON a.segment = p.segment AND a.stratum = p.stratum AND a.item = p.item
      JOIN often b ON b.segment = p.segment AND b.stratum = p.stratum AND b.item = p.other""", "diagonal opposed"),
    "st2_closed_windows": query(f"""SELECT e AS "end", event_type, count(*) AS lists, false AS late FROM events,
        (SELECT CAST(d AS DATE) AS e FROM (SELECT unnest(generate_series((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP + INTERVAL {W} DAY, INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 7)
      WHERE CAST(ts AS DATE) BETWEEN e - {W - 1} AND e AND e + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {C.unsettled_days} DAY GROUP BY 1, 2"""),
    "st2_sliding_tally": query(f"""SELECT e AS "end", event_type, count(*) AS lists FROM events,
        (SELECT CAST(d AS DATE) AS e FROM (SELECT unnest(generate_series((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP + INTERVAL {W} DAY, INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 7)
      WHERE CAST(ts AS DATE) BETWEEN e - {W - 1} AND e GROUP BY 1, 2"""),
}
ORACLES["r5_readings"] = ORACLES["j14_subject_readings"]
ORACLES["r5_quiet"] = ORACLES["j15_quiet_subjects"]
ORACLES["r5_flags"] = ORACLES["j16_subject_flags"]
ORACLES["s16_match_sink"] = query(f"""SELECT match_id, players, CASE WHEN w.ws IS NULL THEN NULL ELSE '{{' || w.ws || '}}' END AS game_wins, winner, score FROM ({MATCHES})
  LEFT JOIN (SELECT match_id, string_agg('"' || player || '":' || n, ',' ORDER BY player) AS ws FROM (SELECT match_id, player, count(*) AS n FROM ({CONV_LOG}) WHERE won GROUP BY 1, 2) GROUP BY 1) w USING (match_id)""")
