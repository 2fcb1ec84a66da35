"""Streams against batch results: restarts, repeats and late data."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from colophon.operators import merging
from colophon.sources import versioned
from colophon.streaming import jobs

SCHEMA = "event_id long, ts timestamp_ntz, session_id long, event_type string, work_id long"
COUNTS = "window_start timestamp, window_end timestamp, event_type string, events long"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def add(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(folder))


def run(spark, folder, out, build, mode="update"):
    jobs.write_batches(build(stream(spark, folder)), f"{out}/table", f"{out}/checkpoint", mode).awaitTermination()


def test_restart_continues_and_late_rows_are_dropped(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    build = lambda s: jobs.stream_event_counts(s, "1 day", delay="1 day")
    add(spark, folder, "a", [(1, at(1, 5), 1, "view", 1), (2, at(1, 6), 1, "view", 1), (3, at(2, 1), 1, "click", 1)])
    run(spark, folder, out, build)
    add(spark, folder, "b", [(4, at(1, 23), 1, "view", 1), (5, at(9), 1, "view", 1)])  # out of order, still in time
    run(spark, folder, out, build)
    add(spark, folder, "c", [(6, at(1, 2), 1, "view", 1), (7, at(9, 3), 1, "view", 1)])  # day 1 closed by day 9
    run(spark, folder, out, build)
    stored = jobs.read_batches(spark, f"{out}/table", COUNTS)
    latest = jobs.read_latest(stored, ["window_start", "event_type"]).withColumn("day", F.dayofmonth(jobs.wall_time(F.col("window_start"))))
    assert sorted((r.day, r.event_type, r.events) for r in latest.collect()) == [(1, "view", 3), (2, "click", 1), (9, "view", 2)]


def test_sessions_close_after_the_gap(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    rows = [(1, at(1, 1, 0), 7, "view", 1), (2, at(1, 1, 20), 7, "view", 1), (3, at(1, 2, 0), 7, "view", 1), (4, at(2), 8, "view", 1)]
    add(spark, folder, "a", rows)
    run(spark, folder, out, jobs.stream_sessions, "append")
    got = jobs.read_batches(spark, f"{out}/table", "session_id long, started_at timestamp, ended_at timestamp, events long")
    assert sorted((r.session_id, r.events) for r in got.collect()) == [(7, 1), (7, 2)]


def test_ingest_ignores_repeats_across_runs(spark, tmp_path):
    folder, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "items"), str(tmp_path / "cp")
    schema = "post_id long, text string, observed_at timestamp"

    def go():
        posts = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        jobs.stream_ingest_items(posts, table, checkpoint, "posts", "https://p/").awaitTermination()

    def put(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")

    put("a", [(1, "see ABC-123 and abc 123", at(1)), (2, "none here", at(1))])
    go()
    put("b", [(1, "ABC-123 again, XYZ-77", at(20)), (3, "abc-123", at(20))])
    go()
    go()
    rows = jobs.read_batches(spark, table, "source_key string, product_code string").collect()
    assert sorted(r.source_key for r in rows) == ["1:ABC-123", "1:XYZ-77", "3:ABC-123"]


def test_ingest_of_a_second_checkpoint_loses_nothing(spark, tmp_path):
    table, schema = str(tmp_path / "items"), "post_id long, text string, observed_at timestamp"
    for name, rows in (("one", [(1, "ABC-123", at(1)), (2, "DEF-456", at(1))]), ("two", [(2, "DEF-456", at(2)), (3, "GHI-789", at(2))])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        posts = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        jobs.stream_ingest_items(posts, table, str(tmp_path / f"cp-{name}"), "posts", "https://p/").awaitTermination()
    rows = jobs.read_batches(spark, table, "source_key string, product_code string").collect()
    assert sorted(r.source_key for r in rows) == ["1:ABC-123", "2:DEF-456", "3:GHI-789"]


def test_a_tick_closes_open_visits(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    add(spark, folder, "a", [(1, at(1, 1, 0), 7, "view", 1), (2, at(1, 1, 20), 7, "view", 1), (4, at(2), 8, "view", 1)])
    build = lambda s: jobs.stream_sessions(jobs.with_ticks(s, f"{out}/ticks"))
    run(spark, folder, out, build, "append")
    schema = "session_id long, started_at timestamp, ended_at timestamp, events long"
    visits = lambda: sorted((r.session_id, r.events) for r in jobs.read_batches(spark, f"{out}/table", schema).collect())
    assert visits() == [(7, 2)]
    jobs.tick(spark, f"{out}/ticks", "2024-02-01 00:00:00")
    run(spark, folder, out, build, "append")
    assert visits() == [(7, 2), (8, 1)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def go(name, rows):
        add(spark, folder, name, rows)
        jobs.stream_late_rows(stream(spark, folder), out, f"{out}/cp", "1 day", "1 day").awaitTermination()

    go("a", [(1, at(1, 5), 1, "view", 1), (2, at(9), 1, "view", 1)])
    go("b", [(3, at(1, 6), 1, "view", 1), (4, at(8, 1), 1, "click", 1), (5, at(9, 1), 1, "view", 1)])
    go("c", [(6, at(8, 2), 1, "view", 1), (7, at(7, 2), 1, "view", 1)])
    got = jobs.read_late_counts(spark, out).withColumn("day", F.dayofmonth(jobs.wall_time(F.col("window_start"))))
    assert sorted((r.day, r.event_type, r.late, r.events) for r in got.collect()) == [(1, "view", False, 1), (1, "view", True, 1), (7, "view", True, 1), (8, "click", False, 1), (8, "view", False, 1), (9, "view", False, 2)]
    late = versioned.VersionedTable(spark, f"{out}/late").read().collect()
    assert sorted(r.event_id for r in late) == [3, 7] and all(r.watermark is not None for r in late)


# -- versioned tables


def parts_of(table):
    return table.current()["parts"]


def test_parts_stay_few_over_a_thousand_batches():
    parts, most = [], 0
    for k in range(1000):
        parts.append({"folder": str(k), "level": 0})
        while merged := versioned.due(parts, 8):
            parts = [p for p in parts if p not in merged] + [{"folder": f"m{k}", "level": merged[0]["level"] + 1}]
        most = max(most, len(parts))
    assert most <= 7 * 4 and len(parts) <= most


def test_batches_are_merged_and_read_by_bucket(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), "k long, v long, batch long", ["k"], buckets=4, fan=3)
    merge = lambda r: jobs.latest_rows(r, ["k"])
    for n in range(14):
        rows = spark.createDataFrame([(n % 5, n, n), (100, n, n)], "k long, v long, batch long")
        assert table.append(rows, "w", n, merge)
        assert not table.append(rows, "w", n, merge)  # sent again
    assert len(parts_of(table)) <= 2 * 3
    latest = {r["k"]: r["v"] for r in jobs.read_latest(table.read(), ["k"]).collect()}
    assert latest == {0: 10, 1: 11, 2: 12, 3: 13, 4: 9, 100: 13}
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path) for f in names)
    assert files <= 8 * 4 * 3
    buckets = table.touched(spark.createDataFrame([(100,)], "k long"))
    assert len(buckets) == 1 and 100 in {r["k"] for r in table.read(buckets).collect()}
    plan = table.read(buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]


def test_overwrite_survives_a_kill_between_its_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "works")
    merging.overwrite_table(spark.range(5), path)
    ids = lambda: sorted(r["id"] for r in merging.read_table(spark, path).collect())
    before = merging.read_table(spark, path)
    # killed after the data, before the manifest
    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            merging.overwrite_table(spark.range(9), path)
    assert ids() == [0, 1, 2, 3, 4]
    # killed while the manifest is written
    (tmp_path / "works" / "_versions" / "v0000000002.json").write_text('{"parts": [{"fol')
    assert ids() == [0, 1, 2, 3, 4]
    # the table may be computed from itself, and its readers keep their version
    merging.overwrite_table(merging.read_table(spark, path).withColumn("id", F.col("id") + 10), path)
    assert ids() == [10, 11, 12, 13, 14] and before.count() == 5
    for k in range(3):
        merging.overwrite_table(spark.range(k), path)
    assert ids() == [0, 1] and len([n for n in os.listdir(path) if n.startswith("part=r")]) <= 3


def test_of_two_writers_one_wins(spark, tmp_path):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    base = table.current()
    table.replace(spark.range(4))
    with pytest.raises(versioned.Conflict):
        table._commit(base, parts=[])
    assert table.read().count() == 4
