"""Shared table expressions of the oracle SQL over the driver's tables.

Each is written the direct way, by joins and full spines, so that it agrees with
the engine only where the engine's shortcuts are right.
"""

import re

from basketlens.config import STAR as C

EPOCH = f"DATE '{C.epoch_start}'"
HIST = f"DATE '{C.history_start}'"
SIG = ", ".join(f"'{i}'" for i in C.signature)
NSIG = len(C.signature)
NAMED = "('with', 'without')"
W = C.hype_window_days
T = C.trendsetter_days

CTES: dict[str, str] = {}

CTES["c_lists0"] = """
SELECT o_orderkey AS list_id, CAST(o_custkey AS VARCHAR) AS actor,
  o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m') AS event,
  strftime(o_orderdate, '%Y-%m') || '/' || o_orderpriority AS event_id,
  CASE WHEN o_orderpriority IN ('5-LOW','4-NOT SPECIFIED','3-MEDIUM') THEN 'league' ELSE o_orderpriority END AS event_class,
  CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority
FROM orders"""
CTES["c_ranked"] = """
SELECT *, CASE WHEN event_class <> 'league' THEN CAST(row_number() OVER (PARTITION BY event_id ORDER BY price DESC, list_id) AS INTEGER) END AS placement,
  CASE WHEN event_class <> 'league' THEN CAST(3 * floor(price / 50000) AS INTEGER) END AS points,
  CASE WHEN status = 'F' THEN '5-0' END AS record
FROM c_lists0"""
CTES["c_entries"] = """
SELECT l_orderkey AS list_id, CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'b' END AS board, 'type:' || p_type AS name, p_type AS type
FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'b' END, 'brand:' || p_brand, 'BRAND'
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["c_items0"] = """
SELECT list_id, name AS item, CAST(count(*) FILTER (board = 'a') AS INTEGER) AS qty_a, CAST(count(*) FILTER (board = 'b') AS INTEGER) AS qty_b
FROM c_entries GROUP BY 1, 2"""
CTES["c_totals"] = f"""
SELECT list_id, CAST(count(*) AS INTEGER) AS typed_total FROM c_entries WHERE trim(type) = '{C.typed_label}' AND board = 'a' GROUP BY 1"""
CTES["c_marks"] = f"""
SELECT list_id, count(*) FILTER (item IN ({SIG})) AS held,
  coalesce(sum(qty_a + qty_b) FILTER (item = '{C.divergence_item}'), 0) AS div,
  bool_or(item = '{C.watch_item}') AS watched
FROM c_items0 GROUP BY 1"""
CTES["c_lists"] = f"""
SELECT r.list_id, r.actor, r.event, r.event_id, r.event_class, r.date, r.placement, r.points, r.record, r.status, r.priority, r.price,
  coalesce(t.typed_total, 0) AS typed_total,
  r.points / nullif(max(r.points) OVER (PARTITION BY r.event_id), 0) AS weight,
  coalesce(m.held = {NSIG}, false) AS member,
  coalesce(m.held < {NSIG} AND m.watched, false) AS near_miss,
  CASE WHEN m.held = {NSIG} THEN '{C.cohort}' END AS cohort,
  CASE WHEN m.held = {NSIG} THEN CASE WHEN m.div = 0 THEN 'without' WHEN m.div = 1 THEN 'hybrid' ELSE 'with' END END AS segment,
  CASE WHEN r.event_class = 'league' THEN 'league' ELSE 'challenge-class' END AS stratum
FROM c_ranked r LEFT JOIN c_marks m USING (list_id) LEFT JOIN c_totals t USING (list_id)"""
CTES["c_items"] = """
SELECT l.*, i.item, i.qty_a, i.qty_b FROM c_items0 i JOIN c_lists l USING (list_id)"""
CTES["c_bounds"] = f"""
SELECT as_of, as_of - {C.fresh_days} + 1 AS fresh_start, as_of AS fresh_end,
  greatest({EPOCH}, as_of - {C.fresh_days + C.baseline_days - 1}) AS baseline_start, as_of - {C.fresh_days} AS baseline_end
FROM (SELECT max(date) AS as_of FROM c_lists)"""
CTES["c_scope"] = """
SELECT l.*, l.date > b.baseline_end AS fresh FROM c_lists l, c_bounds b
WHERE l.member AND l.date >= b.baseline_start AND l.date <= b.as_of"""
CTES["c_scopei"] = """
SELECT s.*, i.item, i.qty_a, i.qty_b FROM c_scope s JOIN c_items0 i USING (list_id)"""
CTES["c_pops"] = """
SELECT segment, stratum, count(*) FILTER (fresh) AS fp, count(*) FILTER (NOT fresh) AS bp,
  sum(weight) FILTER (fresh) AS fpw, sum(weight) FILTER (NOT fresh) AS bpw
FROM c_scope GROUP BY 1, 2"""


def adoption(source: str, keys: str) -> str:
    def window(name, lists, weight, pop, popw):
        ad = f"CASE WHEN {pop} > 0 THEN {lists} / {pop} END"
        we = f"CASE WHEN stratum = 'challenge-class' AND {pop} > 0 AND {popw} <> 0 THEN coalesce({weight}, 0.0) / {popw} END"
        return (f"{lists} AS {name}_lists, {pop} AS {name}_population, {ad} AS {name}_adoption, "
                f"{we} AS {name}_weighted, {we} - {ad} AS {name}_tilt")
    return f"""
SELECT segment, stratum, {keys}, {window('fresh', 'fl', 'fw', 'fp', 'fpw')}, {window('baseline', 'bl', 'bw', 'bp', 'bpw')},
  CASE WHEN fp > 0 AND bp > 0 THEN fl / fp - bl / bp END AS delta
FROM (SELECT segment, stratum, {keys}, count(*) FILTER (fresh) AS fl, count(*) FILTER (NOT fresh) AS bl,
        sum(weight) FILTER (fresh) AS fw, sum(weight) FILTER (NOT fresh) AS bw FROM {source} GROUP BY ALL)
JOIN c_pops USING (segment, stratum)"""


CTES["c_adoption"] = adoption("c_scopei", "item, qty_a, qty_b")
CTES["c_landtab"] = adoption("c_scope", "typed_total")
CTES["c_byitem"] = """
SELECT a.segment, a.stratum, a.item, a.playing_lists, a.population, a.playing_lists / a.population AS segment_playing,
  l.qty_a AS lead_a, l.qty_b AS lead_b, l.fresh_adoption AS lead_adoption, l.fresh_tilt AS lead_tilt, l.delta AS lead_delta
FROM (SELECT segment, stratum, item, CAST(sum(fresh_lists) AS BIGINT) AS playing_lists, max(fresh_population) AS population
      FROM c_adoption WHERE fresh_lists > 0 GROUP BY 1, 2, 3) a
JOIN (SELECT *, row_number() OVER (PARTITION BY segment, stratum, item ORDER BY fresh_lists DESC, qty_a, qty_b) AS rn
      FROM c_adoption WHERE fresh_lists > 0) l
  ON a.segment = l.segment AND a.stratum = l.stratum AND a.item = l.item AND l.rn = 1"""

# Series: cohort since the epoch, and the cohort with its near misses since the start.
CTES["c_mem"] = f"SELECT * FROM c_lists WHERE member AND date >= {EPOCH}"
CTES["c_memi"] = f"SELECT * FROM c_items WHERE member AND date >= {EPOCH}"
CTES["c_hist"] = f"SELECT * FROM c_lists WHERE (member OR near_miss) AND date >= {HIST}"
CTES["c_histi"] = f"SELECT * FROM c_items WHERE (member OR near_miss) AND date >= {HIST}"
CTES["c_last"] = "SELECT max(date) AS last FROM c_mem"

# Hype.
CTES["c_ends"] = f"""
SELECT CAST(d AS DATE) AS e FROM (SELECT unnest(generate_series({EPOCH}, (SELECT last FROM c_last), INTERVAL 1 DAY)) AS d) WHERE CAST(isodow(d) AS INTEGER) = 7"""


def _roles(prefix: str) -> str:
    now, before, after = (f"date BETWEEN e - {W - 1} AND e", f"date BETWEEN e - {2 * W - 1} AND e - {W}",
                          f"date BETWEEN e + 1 AND e + {W}")
    out = []
    for role, when in (("now", now), ("before", before), ("after", after)):
        out.append(f"count(*) FILTER (stratum = 'league' AND {when}) AS {prefix}{role}_l")
        out.append(f"count(*) FILTER (stratum <> 'league' AND {when}) AS {prefix}{role}_c")
        out.append(f"coalesce(sum(coalesce(weight, 0)) FILTER (stratum <> 'league' AND {when}), 0) AS {prefix}{role}_w")
    return ", ".join(out)


CTES["c_hpop"] = f"""
SELECT segment, e, {_roles('p')} FROM c_ends JOIN c_mem ON date BETWEEN e - {2 * W - 1} AND e + {W} GROUP BY 1, 2"""
CTES["c_hkey"] = f"""
SELECT segment, item, qty_a, qty_b, e, {_roles('k')} FROM c_ends JOIN c_memi ON date BETWEEN e - {2 * W - 1} AND e + {W} GROUP BY 1, 2, 3, 4, 5"""
CTES["c_orig"] = f"""
SELECT * FROM (SELECT segment, item, qty_a, qty_b, e, actor AS origin_actor, event AS origin_event, date AS origin_date, placement AS origin_placement,
    row_number() OVER (PARTITION BY segment, item, qty_a, qty_b, e ORDER BY placement, date, actor, list_id) AS rn
  FROM c_ends JOIN c_memi ON date BETWEEN e - {2 * W - 1} AND e WHERE stratum <> 'league' AND placement <= {C.hype_origin_placement}) WHERE rn = 1"""
CTES["c_spk"] = f"""
SELECT k.*, p.* EXCLUDE (segment, e), o.origin_actor, o.origin_event, o.origin_date, o.origin_placement,
  kbefore_l / pbefore_l AS from_adoption, know_l / pnow_l AS to_adoption
FROM c_hkey k JOIN c_hpop p USING (segment, e) JOIN c_orig o USING (segment, item, qty_a, qty_b, e)
WHERE pnow_l >= {C.hype_min_lists} AND pbefore_l >= {C.hype_min_lists}
  AND know_l / pnow_l >= {C.hype_ceiling} AND kbefore_l / pbefore_l < {C.hype_floor}"""
CTES["c_nxt"] = f"""
SELECT a.segment, a.item, a.qty_a, a.qty_b, a.e, min(b.e) AS nxt, row_number() OVER (PARTITION BY a.segment, a.item, a.qty_a, a.qty_b ORDER BY a.e) AS rn
FROM c_spk a LEFT JOIN c_spk b ON a.segment = b.segment AND a.item = b.item AND a.qty_a = b.qty_a AND a.qty_b = b.qty_b AND b.e > a.e + {W}
GROUP BY 1, 2, 3, 4, 5"""
CTES["c_acc"] = """
SELECT segment, item, qty_a, qty_b, e, nxt FROM c_nxt WHERE rn = 1
UNION ALL
SELECT n.segment, n.item, n.qty_a, n.qty_b, n.e, n.nxt FROM c_acc a JOIN c_nxt n
  ON a.segment = n.segment AND a.item = n.item AND a.qty_a = n.qty_a AND a.qty_b = n.qty_b AND n.e = a.nxt"""
CTES["c_mature"] = f"""
SELECT DISTINCT e FROM c_ends JOIN c_mem ON date BETWEEN e + 1 AND e + {W} WHERE stratum <> 'league' AND isodow(date) >= 6"""
CTES["c_stand"] = f"""
SELECT segment, item, qty_a, qty_b, count(*) AS n FROM c_memi, c_last WHERE stratum = 'league' AND date >= last - {C.fresh_days - 1} GROUP BY 1, 2, 3, 4"""
CTES["c_standp"] = f"""
SELECT segment, count(*) AS n FROM c_mem, c_last WHERE stratum = 'league' AND date >= last - {C.fresh_days - 1} GROUP BY 1"""
CTES["c_hype0"] = f"""
SELECT s.*, m.e IS NOT NULL AS matured, pafter_c >= {C.hype_min_lists} AS thick,
  CASE WHEN pnow_c > 0 THEN know_c / pnow_c END AS challenge_before,
  CASE WHEN pafter_c > 0 THEN kafter_c / pafter_c END AS after0,
  CASE WHEN sp.n > 0 THEN coalesce(st.n, 0) / sp.n END AS now_adoption, last
FROM c_spk s JOIN c_acc a USING (segment, item, qty_a, qty_b, e) LEFT JOIN c_mature m USING (e)
LEFT JOIN c_stand st USING (segment, item, qty_a, qty_b) LEFT JOIN c_standp sp USING (segment), c_last"""
CTES["c_hype"] = f"""
SELECT 'hype' AS kind, segment, item, qty_a, qty_b, e AS raised_on, from_adoption, to_adoption, pnow_l AS population,
  origin_actor, origin_event, origin_date, origin_placement,
  know_w / nullif(pnow_w, 0) - challenge_before AS tilt, challenge_before,
  CASE WHEN NOT matured THEN 'raised' WHEN NOT thick THEN 'matured'
       WHEN coalesce(after0 >= challenge_before, false) OR after0 >= {C.hype_ceiling} THEN 'established' ELSE 'decayed' END AS state,
  CASE WHEN matured AND pafter_l > 0 THEN kafter_l / pafter_l END AS league_after,
  CASE WHEN matured AND thick THEN after0 END AS challenge_after,
  CASE WHEN matured AND thick THEN kafter_w / nullif(pafter_w, 0) - after0 END AS tilt_after,
  CASE WHEN matured THEN least(e + {W}, last) END AS resolved_on, now_adoption,
  CASE WHEN now_adoption < {C.hype_floor} THEN 'lapsed' WHEN now_adoption IS NOT NULL THEN 'holding' END AS standing
FROM c_hype0"""

# Novelty and fringe flags.
CTES["c_plays"] = "SELECT item, date, count(*) FILTER (member) AS plays FROM c_histi GROUP BY 1, 2"
CTES["c_days"] = """
SELECT date, coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lists_before
FROM (SELECT date, count(*) FILTER (member) AS n FROM c_hist GROUP BY 1)"""
CTES["c_nov"] = f"""
SELECT item, date, plays_before, lists_before,
  CASE WHEN lists_before > 0 THEN plays_before / lists_before ELSE 0.0 END AS historical_adoption,
  coalesce(date - seen >= {C.return_absence_days}, false) AS "returning",
  CASE WHEN date - seen >= {C.return_absence_days} THEN CAST(date - seen AS INTEGER) END AS absent_days
FROM (SELECT p.item, p.date, CAST(coalesce(sum(q.plays), 0) AS BIGINT) AS plays_before, max(q.date) FILTER (q.plays > 0) AS seen
      FROM c_plays p LEFT JOIN c_plays q ON p.item = q.item AND q.date < p.date GROUP BY 1, 2)
JOIN c_days USING (date)"""
CTES["c_novel"] = f'''SELECT *, "returning" OR historical_adoption < {C.fringe_adoption} AS fringe FROM c_nov'''
CTES["c_fringe"] = f"""
SELECT 'fringe' AS kind, segment, item, qty_a, qty_b, date AS appeared_on, actor, event, placement, historical_adoption, "returning", absent_days
FROM (SELECT i.*, n.historical_adoption, n."returning", n.absent_days,
        row_number() OVER (PARTITION BY i.segment, i.item ORDER BY i.date, i.actor, i.list_id) AS rn
      FROM c_items i JOIN c_novel n USING (item, date)
      WHERE i.member AND n.fringe AND i.date > (SELECT max(date) FROM c_lists WHERE member AND date >= {HIST}) - {C.fresh_days})
WHERE rn = 1"""

# Actors.
CTES["c_proven"] = f"""
SELECT actor, count(*) AS finishes FROM c_mem, c_last
WHERE stratum <> 'league' AND placement <= {C.proven_placement} AND date <= last - {C.fresh_days}
GROUP BY 1 HAVING count(*) >= {C.proven_finishes}"""
CTES["c_pact"] = f"""
SELECT segment, item, qty_a, qty_b, actor, count(*) AS n, min(date) AS since,
  count(*) FILTER (stratum <> 'league' AND placement <= {C.proven_placement}) AS finishes
FROM c_memi WHERE segment IN {NAMED} GROUP BY 1, 2, 3, 4, 5"""
CTES["c_pets"] = f"""
SELECT 'pet-tech' AS kind, segment, item, qty_a, qty_b, CAST(sum(n) AS BIGINT) AS appearances,
  string_agg(actor, ',' ORDER BY actor) AS actors, min(since) AS appeared_on,
  coalesce(string_agg(actor || '|' || finishes, ';' ORDER BY actor) FILTER (p IS NOT NULL AND finishes > 0), '') AS dissenters,
  coalesce(bool_or(p IS NOT NULL AND finishes >= {C.proven_finishes}), false) AS hypothesis_candidate
FROM (SELECT a.*, v.actor AS p FROM c_pact a LEFT JOIN c_proven v USING (actor))
GROUP BY 2, 3, 4, 5 HAVING sum(n) >= {C.pet_appearances} AND count(*) <= {C.pet_actors}"""

# Departures.
CTES["c_seen"] = f"""
SELECT l.*, s.against, coalesce(l.segment = s.against, false) AS own
FROM c_hist l JOIN (SELECT unnest(['with', 'without']) AS against) s
  ON (l.segment IN {NAMED} AND l.segment = s.against) OR l.segment IS NULL OR l.segment NOT IN {NAMED}
WHERE l.date >= {EPOCH}"""
CTES["c_seeni"] = "SELECT s.*, i.item, i.qty_a, i.qty_b FROM c_seen s JOIN c_items0 i USING (list_id)"
CTES["c_size"] = """
SELECT against, stratum, date, n, CAST(coalesce(sum(n) OVER (PARTITION BY against, stratum ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS size_before
FROM (SELECT against, stratum, date, count(*) FILTER (own) AS n FROM c_seen GROUP BY 1, 2, 3)"""
CTES["c_spine"] = """
SELECT against, stratum, date, size_before, item,
  CAST(coalesce(sum(coalesce(p.plays, 0)) OVER (PARTITION BY against, stratum, item ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS plays_before
FROM c_size CROSS JOIN (SELECT DISTINCT item FROM c_seeni)
LEFT JOIN (SELECT against, stratum, date, item, count(*) FILTER (own) AS plays FROM c_seeni GROUP BY 1, 2, 3, 4) p USING (against, stratum, date, item)"""
CTES["c_settled"] = f"SELECT * FROM c_spine WHERE size_before >= {C.departure_min_lists}"
CTES["c_ok"] = f"""
SELECT s.* FROM c_seen s JOIN c_size z USING (against, stratum, date)
WHERE z.size_before >= {C.departure_min_lists} AND (stratum = 'league' OR placement <= {C.departure_placement})"""
CTES["c_ndep"] = f"""
SELECT o.list_id, o.against, count(*) AS n, string_agg(i.item || '|' || i.qty_a || '|' || i.qty_b, ';' ORDER BY i.item) AS novel,
  bool_or(t.plays_before = 0 AND v.fringe) AS introduced
FROM c_ok o JOIN c_items0 i USING (list_id) JOIN c_settled t ON t.against = o.against AND t.stratum = o.stratum AND t.date = o.date AND t.item = i.item
JOIN c_novel v ON v.item = i.item AND v.date = o.date
WHERE t.plays_before / t.size_before < {C.supported_minority} GROUP BY 1, 2"""
CTES["c_mdep"] = f"""
SELECT o.list_id, o.against, count(*) AS n, string_agg(t.item, ',' ORDER BY t.item) AS missing
FROM c_ok o JOIN c_settled t ON t.against = o.against AND t.stratum = o.stratum AND t.date = o.date
LEFT JOIN c_items0 i ON i.list_id = o.list_id AND i.item = t.item
WHERE t.plays_before / t.size_before >= {C.core_adoption} AND i.item IS NULL GROUP BY 1, 2"""
CTES["c_cand"] = """
SELECT * FROM (SELECT o.list_id, o.against, o.own, o.stratum, o.actor, o.event, o.date, o.placement,
    CAST(coalesce(n.n, 0) + coalesce(m.n, 0) AS INTEGER) AS delta, coalesce(n.novel, '') AS novel, coalesce(m.missing, '') AS missing,
    coalesce(n.introduced, false) AS introduced,
    row_number() OVER (PARTITION BY o.list_id ORDER BY coalesce(n.n, 0) + coalesce(m.n, 0), o.against) AS rn
  FROM c_ok o LEFT JOIN c_ndep n USING (list_id, against) LEFT JOIN c_mdep m USING (list_id, against)) WHERE rn = 1"""
CTES["c_dep"] = f"""
SELECT 'breakthrough' AS kind, against AS segment, stratum, list_id, actor, event, date, placement,
  CASE WHEN introduced THEN 'fringe' WHEN delta >= {C.departure_delta} THEN 'in-pool' END AS mode, delta, novel, missing
FROM c_cand WHERE (own OR delta <= {C.departure_ceiling}) AND (introduced OR delta >= {C.departure_delta})"""
CTES["c_debut"] = "SELECT actor, min(date) AS debut FROM c_hist GROUP BY 1"
CTES["c_first"] = "SELECT actor, item, min(date) AS first FROM c_histi GROUP BY 1, 2"
CTES["c_opened"] = """
SELECT list_id, date, split_part(s, '|', 1) AS item FROM (SELECT list_id, date, unnest(string_split(novel, ';')) AS s FROM c_dep WHERE novel <> '')"""
CTES["c_fol"] = f"""
SELECT o.list_id, o.date, o.item, f.actor AS follower, f.first AS taken_up FROM c_opened o
JOIN c_first f ON f.item = o.item AND f.first > o.date AND f.first <= o.date + {T} JOIN c_debut d ON d.actor = f.actor AND d.debut <= o.date"""
CTES["c_most"] = """
SELECT * FROM (SELECT o.list_id, o.item AS adopted_item, coalesce(c.n, 0) AS followers,
    row_number() OVER (PARTITION BY o.list_id ORDER BY coalesce(c.n, 0) DESC, o.item) AS rn
  FROM c_opened o LEFT JOIN (SELECT list_id, item, count(*) AS n FROM c_fol GROUP BY 1, 2) c USING (list_id, item)) WHERE rn = 1"""
CTES["c_bar"] = f"""
SELECT d.date, count(DISTINCT h.actor) AS field,
  greatest({C.trendsetter_followers}, CAST(round_even(CAST({C.trendsetter_share} AS DOUBLE) * count(DISTINCT h.actor), 0) AS INTEGER)) AS needed
FROM (SELECT DISTINCT date FROM c_dep) d LEFT JOIN c_hist h ON h.date > d.date AND h.date <= d.date + {T} GROUP BY 1"""
CTES["c_brk"] = f"""
SELECT d.*, CASE WHEN coalesce(m.followers, 0) >= b.needed THEN 'trendsetter'
    WHEN d.date + {T} > (SELECT max(date) FROM c_hist) THEN 'watching' ELSE 'breakthrough' END AS state,
  coalesce(m.followers, 0) AS followers, m.adopted_item, b.needed
FROM c_dep d LEFT JOIN c_most m USING (list_id) JOIN c_bar b USING (date)"""


# Outcome.
def _counts(prefix: str) -> str:
    return (f"count(*) FILTER (stratum = 'league') AS {prefix}ll, count(*) FILTER (stratum <> 'league') AS {prefix}cl, "
            f"count(*) FILTER (stratum <> 'league' AND placement IS NOT NULL) AS {prefix}rk, "
            f"count(*) FILTER (stratum <> 'league' AND placement <= {C.proven_placement}) AS {prefix}md, "
            f"count(DISTINCT actor) FILTER (stratum = 'league') AS {prefix}la, count(DISTINCT actor) FILTER (stratum <> 'league') AS {prefix}ca")


CTES["c_armed"] = """
SELECT * FROM (SELECT *, unnest(['any count', CASE WHEN qty_a > 0 THEN 'board a' END, CASE WHEN qty_b > 0 THEN 'board b' END, qty_a || '/' || qty_b]) AS arm FROM c_memi)
WHERE arm IS NOT NULL"""
CTES["c_armn"] = f"""
SELECT * FROM (SELECT segment, item, arm, {_counts('')} FROM c_armed GROUP BY 1, 2, 3) JOIN (SELECT segment, {_counts('t')} FROM c_mem GROUP BY 1) USING (segment)"""
CTES["c_tab"] = """
SELECT segment, item, arm, md AS a, rk - md AS b, tmd - md AS c, (trk - rk) - (tmd - md) AS d FROM c_armn"""
CTES["c_hits"] = """
SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM (SELECT DISTINCT a, b, c, d FROM c_tab)"""
_ln = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"
_pm = lambda k: f"exp({_ln('(a + b)', k)} + {_ln('(c + d)', f'(a + c - {k})')} - {_ln('(a + b + c + d)', '(a + c)')})"
CTES["c_fisher"] = f"""
SELECT a, b, c, d, CASE WHEN (a + b) = 0 OR (c + d) = 0 OR (a + c) = 0 OR (b + d) = 0 THEN 1.0
  ELSE least(1.0, sum(pk) FILTER (pk <= pa + 1e-12)) END AS p
FROM (SELECT *, {_pm('k')} AS pk, {_pm('a')} AS pa FROM c_hits) GROUP BY a, b, c, d"""
_cap = f"""CASE WHEN gap IS NULL OR uncapped IS NULL THEN NULL WHEN gap * uncapped < 0 THEN 'flips'
  WHEN abs(gap) < {C.cap_collapse} * abs(uncapped) THEN 'collapses' ELSE 'holds' END AS cap_effect"""
CTES["c_contrast"] = f"""
SELECT *, {_cap} FROM (
  SELECT n.segment, n.item, n.arm, rk AS with_lists, md AS with_made, md / nullif(rk, 0) AS with_rate,
    trk - rk AS without_lists, tmd - md AS without_made, (tmd - md) / nullif(trk - rk, 0) AS without_rate,
    md / nullif(rk, 0) - (tmd - md) / nullif(trk - rk, 0) AS difference, f.p,
    CASE WHEN rk > 0 AND trk - rk > 0 THEN {C.power_z} * sqrt(greatest(tmd / trk * (1 - tmd / trk) * (1 / rk + 1 / (trk - rk)), 0)) END AS floor,
    CASE WHEN f.p < {C.alpha} THEN 'separates' ELSE 'undetectable' END AS state,
    la AS league_actors, ca AS challenge_actors, la / nullif(tla, 0) AS league_share, ca / nullif(tca, 0) AS challenge_share,
    la / nullif(tla, 0) - ca / nullif(tca, 0) AS gap, ll / nullif(tll, 0) - cl / nullif(tcl, 0) AS uncapped
  FROM c_armn n JOIN c_tab t USING (segment, item, arm) JOIN c_fisher f USING (a, b, c, d))"""

# Weekly.
P1, P2 = C.panel_names
CTES["c_wl"] = f"""
SELECT l.list_id, CAST(l.date + (7 - CAST(isodow(l.date) AS INTEGER)) AS DATE) AS week,
  CASE WHEN s <= {C.panel_split_max} AND o BETWEEN {C.panel_other_range[0]} AND {C.panel_other_range[1]} THEN '{P1}'
       WHEN s BETWEEN {C.panel_split_range[0]} AND {C.panel_split_range[1]} THEN '{P2}' END AS panel
FROM c_mem l LEFT JOIN (SELECT list_id, coalesce(sum(qty_a) FILTER (item = '{C.panel_split_item}'), 0) AS s,
    coalesce(sum(qty_a) FILTER (item = '{C.panel_other_item}'), 0) AS o FROM c_memi GROUP BY 1) q USING (list_id)
WHERE l.stratum <> 'league'"""
CTES["c_bin"] = """
SELECT *, CASE WHEN week > settled THEN 'incomplete final week' WHEN panel IS NULL THEN 'neither build' END AS dropped
FROM c_wl, (SELECT CAST(max(date) - (CAST(isodow(max(date)) AS INTEGER) % 7) AS DATE) AS settled FROM c_mem WHERE stratum <> 'league')"""
CTES["c_pw"] = "SELECT panel, week, count(*) AS lists FROM c_bin WHERE dropped IS NULL GROUP BY 1, 2"
CTES["c_typed"] = f"SELECT DISTINCT name AS item FROM c_entries WHERE trim(type) = '{C.typed_label}'"
CTES["c_wavg"] = """
SELECT week, panel, board, item, copies / lists AS avg_copies, lists FROM (
  SELECT b.week, b.panel, i.item, unnest(['mainboard', 'sideboard']) AS board, unnest([sum(i.qty_a), sum(i.qty_b)]) AS copies
  FROM c_bin b JOIN c_items0 i USING (list_id) WHERE b.dropped IS NULL AND i.item NOT IN (SELECT item FROM c_typed) GROUP BY 1, 2, 3)
JOIN c_pw USING (panel, week)"""
CTES["c_movers"] = f"""
SELECT item, max(swing) AS swing FROM (
  SELECT g.panel, g.board, g.item, max(coalesce(a.avg_copies, 0)) - min(coalesce(a.avg_copies, 0)) AS swing
  FROM (SELECT DISTINCT panel, board, item FROM c_wavg) g CROSS JOIN (SELECT DISTINCT week FROM c_pw) w
  LEFT JOIN c_wavg a ON a.panel = g.panel AND a.board = g.board AND a.item = g.item AND a.week = w.week GROUP BY 1, 2, 3)
GROUP BY 1 HAVING max(swing) >= {C.mover_threshold}"""

# Reference baskets.
CTES["c_pick"] = """
SELECT actor AS owner, arg_min(list_id, (date, list_id)) AS one, arg_max(list_id, (date, list_id)) AS two FROM c_lists WHERE member GROUP BY 1"""
CTES["c_ref0"] = """
SELECT owner, 1 AS version, item, qty_a, qty_b FROM c_pick JOIN c_items0 ON list_id = one
UNION ALL SELECT owner, 2, item, qty_a, qty_b FROM c_pick JOIN c_items0 ON list_id = two WHERE one <> two
UNION ALL SELECT p.owner, 2, i.item, 0, 0 FROM c_pick p JOIN c_items0 i ON i.list_id = one
  WHERE one <> two AND NOT EXISTS (SELECT 1 FROM c_items0 x WHERE x.list_id = p.two AND x.item = i.item)"""
CTES["c_ref"] = f"""
SELECT *, CASE WHEN qty_a + qty_b >= 3 THEN 'flex' WHEN item = '{C.divergence_item}' AND qty_a > 0 THEN 'core' END AS override,
  CASE WHEN qty_a + qty_b = 0 THEN 'cut' WHEN qty_a > 0 AND qty_b > 0 THEN 'split over the boards' END AS note FROM c_ref0"""
CTES["c_refp"] = """
SELECT owner, version, segment, population FROM (
  SELECT owner, version, CASE WHEN d = 0 THEN 'without' WHEN d = 1 THEN 'hybrid' ELSE 'with' END AS segment
  FROM (SELECT owner, version, coalesce(sum(qty_a + qty_b) FILTER (item = 'type:PROMO'), 0) AS d FROM c_ref GROUP BY 1, 2))
JOIN (SELECT segment, fp AS population FROM c_pops WHERE stratum = 'challenge-class' AND fp > 0) USING (segment)"""
CTES["c_slots0"] = f"""
SELECT r.*, p.segment, p.population, coalesce(a.fresh_lists, 0) AS lists, coalesce(a.fresh_lists, 0) / p.population AS confidence,
  a.fresh_tilt AS tilt, a.delta, coalesce(b.segment_playing, 0.0) AS segment_playing, b.lead_a, b.lead_b, b.lead_adoption, b.lead_delta,
  CASE WHEN override IS NOT NULL THEN override = 'core' ELSE coalesce(a.fresh_lists, 0) / p.population >= {C.core_adoption} END AS core
FROM c_ref r JOIN c_refp p USING (owner, version)
LEFT JOIN (SELECT * FROM c_adoption WHERE stratum = 'challenge-class') a ON a.segment = p.segment AND a.item = r.item AND a.qty_a = r.qty_a AND a.qty_b = r.qty_b
LEFT JOIN (SELECT * FROM c_byitem WHERE stratum = 'challenge-class') b ON b.segment = p.segment AND b.item = r.item
WHERE r.qty_a + r.qty_b > 0"""
CTES["c_slots"] = f"""
SELECT owner, version, segment, 'challenge-class' AS stratum, item, qty_a, qty_b, population, confidence, lists,
  CASE WHEN core AND confidence < {C.core_adoption} THEN NULL
    WHEN abs(lists - {C.core_adoption} * population) <= {C.boundary_lists} THEN 'core'
    WHEN abs(lists - {C.consensus_adoption} * population) <= {C.boundary_lists} THEN 'consensus'
    WHEN abs(lists - {C.supported_minority} * population) <= {C.boundary_lists} THEN 'supported-minority' END AS boundary,
  tilt, delta, core,
  CASE WHEN NOT core THEN CASE WHEN confidence >= {C.consensus_adoption} THEN 'consensus' WHEN confidence >= {C.supported_minority} THEN 'supported-minority'
    WHEN coalesce(note, '') <> '' THEN 'deliberate-deviation' ELSE 'unexamined-deviation' END END AS bucket,
  note, false AS missing, segment_playing, lead_a, lead_b, lead_adoption, CAST(NULL AS DOUBLE) AS lead_tilt, lead_delta
FROM c_slots0"""


def lacking(bar: float) -> str:
    return f"""
SELECT p.owner, p.version, p.segment, b.item, b.playing_lists, b.population, b.segment_playing, b.lead_a, b.lead_b, b.lead_adoption, b.lead_tilt, b.lead_delta
FROM c_refp p JOIN c_byitem b ON b.segment = p.segment AND b.stratum = 'challenge-class' AND b.segment_playing >= {bar}
WHERE NOT EXISTS (SELECT 1 FROM c_ref r WHERE r.owner = p.owner AND r.version = p.version AND r.item = b.item AND r.qty_a + r.qty_b > 0)"""


CTES["c_missing"] = f"""
SELECT l.owner, l.version, l.segment, 'challenge-class' AS stratum, l.item, 0 AS qty_a, 0 AS qty_b, l.population,
  (l.population - l.playing_lists) / l.population AS confidence, l.population - l.playing_lists AS lists, CAST(NULL AS VARCHAR) AS boundary,
  CAST(NULL AS DOUBLE) AS tilt, CAST(NULL AS DOUBLE) AS delta, false AS core, CAST(NULL AS VARCHAR) AS bucket, r.note, true AS missing,
  segment_playing, lead_a, lead_b, lead_adoption, lead_tilt, lead_delta
FROM ({lacking(C.core_adoption)}) l LEFT JOIN c_ref r ON r.owner = l.owner AND r.version = l.version AND r.item = l.item"""
CTES["c_unplayed"] = f"""
SELECT owner, version, segment, 'challenge-class' AS stratum, item, segment_playing, lead_a, lead_b, lead_adoption, lead_delta, population,
  (population - playing_lists) / population AS confidence, 0 AS dropped, rank, found
FROM (SELECT *, row_number() OVER (PARTITION BY owner, version ORDER BY playing_lists DESC, item) AS rank, count(*) OVER (PARTITION BY owner, version) AS found
      FROM ({lacking(C.unplayed_floor)}))"""
CTES["c_queue"] = """
SELECT *, coalesce(note, '') <> '' AS noted FROM (SELECT * FROM c_slots UNION ALL SELECT * FROM c_missing) WHERE NOT core"""

# Share snapshots.
CTES["c_ev"] = """
SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS cohort FROM events"""
CTES["c_snap"] = """
SELECT captured_on, window_days, cohort, n AS deck_count, n / sum(n) OVER (PARTITION BY captured_on, window_days) AS share FROM (
  SELECT day AS captured_on, 1 AS window_days, cohort, count(*) AS n FROM c_ev GROUP BY 1, 2, 3
  UNION ALL SELECT CAST(day + (7 - CAST(isodow(day) AS INTEGER)) AS DATE), 7, cohort, count(*) FROM c_ev GROUP BY 1, 2, 3)"""
CTES["c_trend"] = f"SELECT * FROM c_snap WHERE cohort = '{C.share_cohort}' AND window_days = {C.share_window_days}"

# Ledger of two runs: the earlier one over the series up to its day.
CUT = "(SELECT baseline_end FROM c_bounds)"
for name, body in list(CTES.items()):
    CTES["k_" + name[2:]] = re.sub(r"\bc_", "k_", body)
CTES["k_lists"] = f"SELECT * FROM c_lists WHERE date <= {CUT}"
CTES["k_items"] = f"SELECT * FROM c_items WHERE date <= {CUT}"

# A store refreshed from a second publication: what of both it holds, everything after that derived from scratch.
U = C.unsettled_days
for name, body in list(CTES.items()):
    if name.startswith("c_"):
        CTES["n_" + name[2:]] = re.sub(r"\bc_", "n_", body)
CTES["n_lists0"], CTES["n_items0"] = "SELECT * FROM c_lists0", "SELECT * FROM c_items0"
CTES["n_pub"] = f"""
SELECT *, list_id % 7 = 0 AND date >= day - 2 AS tardy, list_id % 11 = 0 AND date >= day AS gone
FROM c_ranked, (SELECT max(date) - {U} AS day, min(event_id) AS missed FROM c_ranked)"""
CTES["n_first"] = "SELECT * FROM n_pub WHERE date <= day AND event_id <> missed AND NOT tardy"
CTES["n_ranked"] = """
SELECT * FROM n_first WHERE date < day
UNION ALL SELECT * FROM n_pub WHERE NOT gone AND (date >= day OR event_id NOT IN (SELECT event_id FROM n_first))"""

FLAG_COLUMNS = (
    "kind, segment, item, qty_a, qty_b, raised_on, from_adoption, to_adoption, population, origin_actor, origin_event, "
    "origin_date, origin_placement, tilt, challenge_before, state, league_after, challenge_after, tilt_after, resolved_on, "
    'now_adoption, standing, appeared_on, actor, event, placement, historical_adoption, "returning", absent_days, appearances, '
    "actors, dissenters, hypothesis_candidate, stratum, list_id, date, mode, delta, novel, missing, followers, adopted_item, needed"
)


def _flags(prefix: str, kinds: tuple[str, ...]) -> str:
    return " UNION ALL BY NAME ".join(f"SELECT * FROM {prefix}_{kind}" for kind in kinds)


_ident = """CASE kind WHEN 'hype' THEN concat_ws('~', kind, segment, item, qty_a, qty_b, raised_on) WHEN 'pet-tech' THEN concat_ws('~', kind, segment, item, qty_a, qty_b)
  WHEN 'breakthrough' THEN concat_ws('~', kind, actor, event, date) ELSE concat_ws('~', kind, segment, item) END"""
CTES["c_flags"] = f"SELECT *, {_ident} AS id, 1 AS run FROM ({_flags('c', ('hype', 'fringe', 'pets', 'brk'))})"
CTES["k_flags"] = f"SELECT *, {_ident} AS id, 0 AS run FROM ({_flags('k', ('hype', 'fringe', 'pets', 'brk'))})"
CTES["c_ledger"] = f"""
SELECT {FLAG_COLUMNS}, CASE WHEN old THEN {CUT} ELSE (SELECT max(date) FROM c_lists) END AS first_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY run DESC, list_id) AS rn, bool_or(run = 0) OVER (PARTITION BY id) AS old
  FROM (SELECT * FROM c_flags UNION ALL BY NAME SELECT * FROM k_flags)) WHERE rn = 1"""
CTES["c_lineage"] = """
SELECT b.segment, b.stratum, b.actor, b.event, b.date, b.placement, b.mode, b.delta, b.novel, b.missing, b.state AS followed, b.followers, b.needed,
  b.adopted_item, e.item AS spread_item, e.raised_on AS spiked_on, e.state AS resolved, e.standing
FROM (SELECT * FROM c_ledger WHERE kind = 'breakthrough') b
LEFT JOIN (SELECT o.list_id, h.item, h.raised_on, h.state, h.standing,
    row_number() OVER (PARTITION BY o.list_id ORDER BY h.raised_on, h.item, h.first_seen, h.qty_a, h.qty_b) AS rn
  FROM (SELECT l.list_id, l.segment, l.date, split_part(s.s, '|', 1) AS item FROM c_ledger l, unnest(string_split(l.novel, ';')) AS s(s) WHERE l.kind = 'breakthrough') o
  JOIN (SELECT * FROM c_ledger WHERE kind = 'hype') h ON h.segment = o.segment AND h.item = o.item AND h.raised_on >= o.date) e
  ON e.list_id = b.list_id AND e.rn = 1"""

# Tracked questions.
CTES["c_subj"] = """
SELECT DISTINCT * FROM (
  SELECT p_type AS hypothesis_id, 'type:' || p_type AS subject, 'mirror' AS conditional_on FROM part
  UNION ALL SELECT p_type, 'lands', 'mirror' FROM part
  UNION ALL SELECT p_brand, 'brand:' || p_brand, NULL FROM part
  UNION ALL SELECT p_brand, 'name:' || p_name, NULL FROM part)"""
CTES["c_spoken"] = """
SELECT hypothesis_id, subject, segment, configuration, fresh_population AS population, fresh_adoption AS adoption, fresh_tilt AS tilt, delta FROM c_subj JOIN (
  SELECT item AS subject, segment, qty_a || '/' || qty_b AS configuration, fresh_population, fresh_adoption, fresh_tilt, delta
  FROM c_adoption WHERE stratum = 'challenge-class' AND fresh_lists > 0
  UNION ALL SELECT 'lands', segment, CAST(typed_total AS VARCHAR), fresh_population, fresh_adoption, fresh_tilt, delta
  FROM c_landtab WHERE stratum = 'challenge-class' AND fresh_lists > 0) USING (subject)"""

RECURSIVE = {"c_acc", "k_acc", "n_acc"}
_REF = re.compile(r"\b[ckn]_[a-z0-9]+\b")


def needed(sql: str, seen: dict | None = None) -> dict[str, str]:
    seen = {} if seen is None else seen
    for name in _REF.findall(sql):
        if name in CTES and name not in seen:
            body = CTES[name]
            seen[name] = ""
            needed(body, seen)
            seen.pop(name)
            seen[name] = body
    return seen


def query(sql: str, floats: str = "") -> str:
    """A full statement: the expressions it needs, then itself with its float
    columns rounded to nine places and no negative zero."""
    parts = []
    for name, body in needed(sql).items():
        parts.append(f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({body})")
    head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    if not floats:
        return head + sql
    rounded = ", ".join(f"CASE WHEN round({f}, 9) = 0 THEN 0.0 ELSE round({f}, 9) END AS {f}" for f in floats.split())
    return f"{head}SELECT * REPLACE ({rounded}) FROM ({sql})"
