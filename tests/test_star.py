"""The star schema run: ranking inside hot events, and parity with plain SQL."""

import random
from pathlib import Path

import pytest
from oracle_check import compare, duck
from pyspark.sql.functions import spark_partition_id

from basketlens.operators.departures import standing_intervals
from basketlens.sources import star
from basketlens.sources.star import in_ranges, ranked_in_event

SMALL = "/root/testdata/sf0.001"
PARITY = (
    "s7_store", "a3_adoption", "a5_conversion_gap", "a13_substitution", "a16_contrast", "a20_weekly_averages",
    "w3_novelty", "d2_fringe", "d7_breakthroughs", "j8_followers", "m1_ledger", "r1_slot_audit", "j12_changes", "d9_index_difference",
)


def test_placements_of_a_hot_event_are_ranked_in_buckets(spark):
    rng = random.Random(5)
    rows = [(n, "hot" if n % 3 else f"e{n % 7}", float(rng.choice([1, 5, 5, 9, rng.random() * 100]))) for n in range(600)]
    rows.append((600, "alone", 4.0))
    got = ranked_in_event(spark.createDataFrame(rows, "list_id bigint, event_id string, price double"), 16)
    want = {}
    for event in {e for _, e, _ in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[1] == event), key=lambda r: (-r[2], r[0])), 1):
            want[row[0]] = place
    assert {r.list_id: r.placement for r in got.collect()} == want


@pytest.mark.parametrize("price", [lambda n: 5.0, lambda n: 1e6 if n == 7 else float(n % 3), float])
def test_one_events_ranges_are_even_whatever_its_prices(spark, price):
    rows = [(n, "one", price(n)) for n in range(20_000)]
    frame = spark.createDataFrame(rows, "list_id bigint, event_id string, price double").repartition(4)
    sizes = [r["count"] for r in in_ranges(frame, 10).groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 20_000 / 10
    got = {r.list_id: r.placement for r in ranked_in_event(frame, 10).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got, key=lambda n: (-price(n), n))


def test_tasks_that_gather_lists_grow_with_the_lines(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id % 900 AS l_orderkey", "id % 5 AS l_partkey", "'F' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(5).selectExpr("id AS p_partkey", "'T' AS p_type", "'B' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(star, "LINES_A_TASK", 100)
    rows = star.item_entries(spark, str(tmp_path), dealt=True).withColumn("task", spark_partition_id()).collect()
    assert len(rows) == 8000 and len({(r.list_id, r.task) for r in rows}) == 900
    assert len({r.task for r in rows}) > 30, "a task has some 100 lines, however well they pack"


def test_intervals_are_counted_without_pairing_them(spark):
    from datetime import date, timedelta

    rng, start = random.Random(8), date(2026, 1, 1)
    day = lambda n: start + timedelta(days=n)
    spans = [(rng.choice("ab"), rng.randrange(40), rng.randrange(-2, 20)) for _ in range(200)]
    probes = [(k, d) for k in "abc" for d in range(0, 60, 3)]
    got = standing_intervals(
        spark.createDataFrame([(k, day(o), day(o + n)) for k, o, n in spans], "item string, opens date, closes date"),
        spark.createDataFrame([(k, day(d)) for k, d in probes], "item string, date date"), "item")
    want = {(k, day(d)): sum(k == i and o <= d < o + n for i, o, n in spans) for k, d in probes}
    assert {(r["item"], r["date"]): r["standing"] for r in got.collect()} == want


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", PARITY)
def test_readings_agree_with_sql(spark, name):
    import __spark_entry__ as entry

    fault, rows, _, _ = compare(spark, duck(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not fault, fault
    assert rows or name in ("j8_followers",)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no driver tables here")
@pytest.mark.parametrize("ends", [1, 4, 100])
def test_ends_of_substitution_are_those_of_the_whole_table(spark, ends):
    from basketlens.operators import movement, series_ops
    from basketlens.plans.star import asked_configurations, run

    r = run(spark, SMALL)
    asked = asked_configurations(r.items)
    whole = series_ops.both_ends(movement.substitution(r.items, r.baskets, asked, r.cfg), ends)
    sparse = movement.substitution_ends(r.items, r.baskets, asked, r.cfg, ends)
    assert set(whole.columns) == set(sparse.columns)
    assert sorted(map(tuple, whole.select(*sparse.columns).collect())) == sorted(map(tuple, sparse.collect())) != []
