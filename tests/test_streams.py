"""Jobs as streams: late rows, windows that close, sessions, restarts, state across batches."""

import datetime as dt

from parley.streaming import jobs

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string, value double"


def at(minute):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def put(spark, folder, rows):
    spark.createDataFrame([(u, i, at(m), k, v) for u, i, m, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, job, name, tmp_path, mode):
    """What a job writes in one run, from where the run before stopped."""
    out = str(tmp_path / f"out-{name}")
    job.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_late_rows_are_dropped_and_closed_windows_come_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    job = lambda: jobs.tumbling(spark.readStream.schema(SCHEMA).parquet(folder), late="10 minutes").selectExpr("w.start as start", "event_type", "events", "value")
    put(spark, folder, [(1, 1, 5, "a", 1.0), (1, 2, 50, "a", 2.0), (1, 3, 65, "a", 3.0)])
    run(spark, job(), "late", tmp_path, "append")
    put(spark, folder, [(1, 4, 130, "a", 4.0)])
    run(spark, job(), "late", tmp_path, "append")
    put(spark, folder, [(1, 5, 20, "a", 100.0), (1, 6, 125, "a", 5.0), (1, 7, 300, "a", 6.0)])
    out = run(spark, job(), "late", tmp_path, "append")
    got = sorted((r.start.hour, r.events, r.value) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2, 3.0), (1, 1, 3.0), (2, 2, 9.0)]  # minute 20 came after its window had closed


def test_sessions_as_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    job = lambda: jobs.sessions(spark.readStream.schema(SCHEMA).parquet(folder)).selectExpr("user_id", "w.start as start", "events")
    put(spark, folder, [(1, 1, 0, "a", 1.0), (1, 2, 20, "a", 1.0), (2, 3, 10, "a", 1.0)])
    run(spark, job(), "sessions", tmp_path, "append")
    put(spark, folder, [(1, 4, 45, "a", 1.0), (1, 5, 200, "a", 1.0)])
    run(spark, job(), "sessions", tmp_path, "append")
    put(spark, folder, [(3, 6, 400, "a", 1.0)])
    out = run(spark, job(), "sessions", tmp_path, "append")
    assert sorted((r.user_id, r.start.minute, r.events) for r in spark.read.parquet(out).collect())[:2] == [(1, 0, 3), (1, 20, 1)]


def test_latest_state_in_update_mode(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [(1, 1, 0, "queued", 0.0), (1, 2, 5, "running", 0.0), (2, 3, 1, "queued", 0.0)])
    put(spark, folder, [(1, 4, 2, "queued", 0.0), (2, 5, 9, "done", 0.0)])
    run(spark, jobs.latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)), "states", tmp_path, "update")
    last = {}
    for r in spark.table("states").collect():
        if r.user_id not in last or r.ts >= last[r.user_id][1]:
            last[r.user_id] = (r.state, r.ts)
    assert {u: s for u, (s, _) in last.items()} == {1: "running", 2: "done"}


def test_throttle_keeps_its_state_over_batches_and_a_restart(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "session string, speaker string, at double, text string"
    job = lambda: jobs.throttled(spark.readStream.schema(schema).parquet(folder))
    for batch in ([("s", "a", 1.0, "x"), ("s", "a", 1.2, "xy"), ("t", "a", 1.0, "z")], [("s", "a", 2.0, "xyz"), ("s", "a", 2.6, "xyzw")], [("s", "a", 2.7, "x" * 50), ("s", "b", 2.8, "n")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        out = run(spark, job(), "throttled", tmp_path, "append")
    assert sorted((r.session, r.at) for r in spark.read.parquet(out).collect()) == [("s", 1.0), ("s", 2.6), ("s", 2.7), ("s", 2.8), ("t", 1.0)]


def test_transitions(spark):
    rows = [(1, 1, 0, "queued", 0.0), (1, 2, 1, "running", 0.0), (1, 3, 2, "queued", 0.0), (1, 4, 3, "done", 0.0), (1, 5, 4, "running", 0.0)]
    df = spark.createDataFrame([(u, i, at(m), k, v) for u, i, m, k, v in rows], SCHEMA)
    assert [r.allowed for r in jobs.transitions(df, ["queued", "running", "done"]).orderBy("event_id").collect()] == [True, True, False, True, False]
