"""Streams give one answer for one file, a folder of parts, and parts in any order of batches."""

from pyspark.sql import functions as F

from basketlens.config import STAR
from basketlens.streaming import tallies

SMALL = "/root/testdata/sf0.001"


def tallied(spark, folder, files):
    events = tallies.stream_events(spark, folder, files)
    made = tallies.run_to_end(tallies.sliding(events, ["event_type"], STAR), ["event_type"], "test-tally")
    return sorted(tuple(r) for r in made.collect())


def test_tallies_are_those_of_one_batch_at_any_layout(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    whole = events.withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(tuple(r) for r in tallies.sliding(whole, ["event_type"], STAR).collect())
    assert want and tallied(spark, SMALL, 1000) == want
    events.orderBy(F.xxhash64("event_id")).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    assert tallied(spark, str(tmp_path), 1) == want


def landed(spark, root, *batches, days=3):
    """Arrivals from files that land one batch after the other: (event, place, day)."""
    from basketlens.streaming import arrivals

    shape = "list_id bigint, event_id string, pos int, event_ts timestamp"
    out = None
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(hash((e, p)) % 10**9, e, p, d) for e, p, d in rows], "list_id bigint, event_id string, pos int, day string")
        made.withColumn("event_ts", F.to_timestamp("day")).drop("day").coalesce(1).write.mode("append").parquet(f"{root}/in")
        # Each call is a restart from the checkpoint.
        stream = spark.readStream.schema(shape).parquet(f"{root}/in")
        out = arrivals.land(stream, f"{root}/out", f"{root}/state", "day", days)
    return sorted((r.event_id, r.pos, r.late) for r in out.collect())


def test_copies_are_dropped_inside_and_after_the_unsettled_days(spark, tmp_path):
    first = [("a", 0, "2026-06-01"), ("a", 1, "2026-06-01"), ("a", 0, "2026-06-01")]
    copies = [("a", 0, "2026-06-01"), ("b", 0, "2026-06-03")]
    later = [("c", 0, "2026-06-20")]
    late = [("a", 1, "2026-06-01"), ("a", 2, "2026-06-01"), ("d", 0, "2026-06-02"), ("c", 0, "2026-06-20"), ("e", 0, "2026-06-17")]
    got = landed(spark, tmp_path, first, copies, later, late)
    assert got == [("a", 0, False), ("a", 1, False), ("a", 2, True), ("b", 0, False), ("c", 0, False), ("d", 0, True), ("e", 0, False)]


def test_a_batch_reads_the_folders_of_its_own_days_only(spark, tmp_path):
    """Folders of other days may even be unreadable."""
    from basketlens.streaming import arrivals

    landed(spark, tmp_path, [("a", 0, "2026-06-01")], [("b", 0, "2026-06-09")])
    broken = tmp_path / "out" / "lists" / "part=2026-06-01" / "batch=0"
    for file in broken.glob("*.parquet"):
        file.write_bytes(b"not a table")
    made = spark.createDataFrame([(7, "b", 0, "2026-06-09"), (8, "b", 1, "2026-06-09")], "list_id bigint, event_id string, pos int, day string")
    made.withColumn("event_ts", F.to_timestamp("day")).drop("day").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("list_id bigint, event_id string, pos int, event_ts timestamp").parquet(f"{tmp_path}/in")
    arrivals.land(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    held = spark.read.parquet(f"{tmp_path}/out/lists/part=2026-06-09").collect()
    assert sorted((r.event_id, r.pos) for r in held) == [("b", 0), ("b", 1)]


def test_closed_windows_and_late_rows_add_up_and_the_state_stays_small(spark, tmp_path):
    """A year of days, a file each, some rows weeks late."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(4), datetime(2025, 1, 6, 12)
    rows = [(n // 7, start + timedelta(days=n // 7 - (40 if rng.random() < 0.05 else rng.choice([0, 0, 1, 2]))), f"item {n % 3}", "league" if n % 2 else "finals") for n in range(7 * 360)]
    for batch in range(24):
        part = [(ts, item, stratum) for day, ts, item, stratum in rows if day // 15 == batch]
        spark.createDataFrame(part, "ts timestamp, item string, stratum string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, item string, stratum string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = tallies.run_closed(events, ["stratum", "item"], STAR, str(tmp_path / "run"))
    whole = tallies.sliding(spark.read.parquet(f"{tmp_path}/in"), ["stratum", "item"], STAR).collect()
    reached = max(ts for _, ts, _, _ in rows) - timedelta(days=STAR.unsettled_days)
    want = {(r.end, r.stratum, r["item"]): r.lists for r in whole if datetime.combine(r.end, datetime.min.time()) + timedelta(days=1) <= reached}
    got = {}
    for row in [*done.windows.collect(), *done.late.collect()]:
        key = (row.end, row.stratum, row["item"])
        got[key] = got.get(key, 0) + row.lists
    assert got == want
    assert done.late.count() and done.windows.count() == done.windows.select("end", "stratum", "item").distinct().count()
    half = len(done.state_rows) // 2
    assert max(done.state_rows[half:]) <= max(done.state_rows[:half]) <= 60
