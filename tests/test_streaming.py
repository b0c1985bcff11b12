"""Streaming jobs over several micro-batches against the batch operators."""

from pyspark.sql import functions as F

from tripwise.operators import feedback as B
from tripwise.streaming import jobs as L
from tripwise.streaming import ordered as O

EVENTS = "/root/testdata/sf0.001/events.parquet"


def feedback(events):
    return events.select(
        "event_id", "ts", "user_id", (F.col("event_id") % 7).alias("place_id"), F.lit("google_maps").alias("source"),
        F.when(F.col("event_id") % 3 == 0, "like").when(F.col("event_id") % 3 == 1, "dislike").otherwise("visit").alias("kind"),
        (F.col("value") / 50).alias("strength"), F.col("value").alias("money"), (F.col("event_id") % 50).alias("travel_min"),
        ((F.col("event_id") % 201 - 100) * 0.01).alias("satisfaction"))


def files(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    for i in range(3):  # in time order, one file per micro-batch
        folder = str(tmp_path / f"part{i}")
        events.where((F.dayofmonth("ts") > i * 10) & (F.dayofmonth("ts") <= i * 10 + 10)).coalesce(1).write.parquet(folder)
    return events, L.read_events(spark, str(tmp_path / "part*"), files_per_batch=1)


def part_rows(spark, folder):
    return {b: spark.read.parquet(f"{folder}/batch={b}").count() for b in L.parts(spark, folder, "batch")}


def test_counters_and_compaction(spark, tmp_path):
    """The log is folded into a base table; older parts go and nothing is lost."""
    events, stream = files(spark, tmp_path)
    out = str(tmp_path / "out")
    L.run_updates(L.place_counters(feedback(stream)), out, str(tmp_path / "cp"), ["place_id"], compact_every=1)
    assert L.parts(spark, out, "base") == [1, 2] and L.parts(spark, out, "batch") == [2]
    got = sorted(map(tuple, L.latest(spark, out, ["place_id"]).select("place_id", "visits", "likes", "dislikes").collect()))
    want = feedback(events).groupBy("place_id").agg(*[F.sum((F.col("kind") == k).cast("long")) for k in ("visit", "like", "dislike")])
    assert got == sorted(map(tuple, want.collect()))
    # a batch that runs again finds what it needs and changes nothing
    L.compact(spark, out, ["place_id"], 2)
    assert sorted(map(tuple, L.latest(spark, out, ["place_id"]).select("place_id", "visits", "likes", "dislikes").collect())) == got


def test_a_job_goes_on_after_a_restart(spark, tmp_path):
    """Two runs on one checkpoint; a batch logs only the keys it touched."""
    events = spark.read.parquet(EVENTS)
    early, late = events.where(F.dayofmonth("ts") <= 20), events.where((F.dayofmonth("ts") > 20) & (F.col("user_id") % 2 == 0))
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    early.coalesce(1).write.parquet(f"{source}/a")
    L.stream_travel_cost(feedback(L.read_events(spark, f"{source}/*")), out, cp)
    first = part_rows(spark, out)
    late.coalesce(1).write.parquet(f"{source}/b")
    L.stream_travel_cost(feedback(L.read_events(spark, f"{source}/*")), out, cp)
    added = [b for b in L.parts(spark, out, "batch") if b not in first]
    touched = {r.user_id for b in added for r in spark.read.parquet(f"{out}/batch={b}").collect()}
    held = {r.user_id for r in early.where(F.col("ts") >= F.lit(early.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0])).collect()}
    assert touched <= {r.user_id for r in late.select("user_id").distinct().collect()} | held
    want = {r.user_id: r for r in B.travel_cost_state(feedback(early.unionByName(late))).collect()}
    got = {r.user_id: r for r in L.with_tail(spark, cp, ["user_id"], L.travel_cost_fold).collect()}
    assert got.keys() == want.keys()
    for u in want:
        assert got[u].n == want[u].n and abs(got[u].vot - want[u].vot) < 1e-9 and abs(got[u].avg_travel_cost - want[u].avg_travel_cost) < 1e-9


def test_late_events_are_left_out(spark, tmp_path):
    """An event behind the watermark changes nothing; one within the delay is put in its place."""
    schema = "event_id bigint, ts timestamp, user_id bigint, place_id bigint, source string, kind string, strength double"
    rows = [(1, "2024-01-01 10:00:00", "like", 2.0), (2, "2024-01-01 10:30:00", "like", 2.0)], [
        (3, "2024-01-01 10:05:00", "dislike", 2.0), (4, "2024-01-01 10:25:00", "dislike", 2.0), (5, "2024-01-01 11:30:00", "like", 1.0)], [
        (6, "2024-01-01 12:30:00", "like", 1.0)]
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i, part in enumerate(rows):
        full = [(e, ts, 1, 7, "google_maps", kind, strength) for e, ts, kind, strength in part]
        df = spark.createDataFrame(full, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{source}/{i}")
        L.stream_affinity(L.read_events(spark, f"{source}/*"), out, cp)
    # 0.24 - 0.24 (within the delay) + 0.24 + 0.12 + 0.12; the event of 10:05 came too late
    (row,) = L.with_tail(spark, cp, L.PLACE_KEYS, L.affinity_fold).collect()
    assert abs(row.aff - 0.48) < 1e-12
    (row,) = L.latest(spark, out, L.PLACE_KEYS).collect()
    assert abs(row.aff - 0.36) < 1e-12  # the last event still waits


def test_sliding_windows_come_from_panes(spark, tmp_path):
    events, stream = files(spark, tmp_path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    L.run_updates(L.sliding_visits(feedback(stream)), out, cp, L.PANE_KEYS, mode="append")
    got = L.latest(spark, out, L.PANE_KEYS).unionByName(L.open_windows(spark, cp))
    visits = feedback(events).where("kind = 'visit'").withColumn("ts", F.col("ts").cast("timestamp"))
    want = visits.groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "place_id").agg(F.count("*").alias("visits")).select("w.start", "place_id", "visits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the shuffle of the first aggregate has a row per pane and place
    plan = L.sliding_visits(feedback(events))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") <= 1


def test_a_job_without_events(spark, tmp_path):
    assert L.latest(spark, str(tmp_path / "none"), ["user_id"]) is None
    assert L.with_tail(spark, str(tmp_path / "none"), ["user_id"], L.travel_cost_fold) is None


def test_events_wait_without_python_and_null_is_a_key(spark, tmp_path):
    """Copies of an event count each; the state of a null user goes on in the next batch."""
    schema = "event_id bigint, ts string, user_id bigint, place_id bigint, source string, kind string, strength double"
    parts = [[(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00")], [(3, "2024-01-01 12:00:00")], [(4, "2024-01-01 13:00:00")]]
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i, part in enumerate(parts):
        full = [(e, ts, None, 7, "google_maps", "like", 1.0) for e, ts in part]
        spark.createDataFrame(full, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{source}/{i}")
        stream = L.read_events(spark, f"{source}/*")
        L.stream_affinity(stream, out, cp)
    (row,) = L.latest(spark, out, L.PLACE_KEYS).collect()
    assert row.user_id is None and abs(row.aff - 0.48) < 1e-12
    (row,) = L.with_tail(spark, cp, L.PLACE_KEYS, L.affinity_fold).collect()
    assert row.user_id is None and abs(row.aff - 0.60) < 1e-12
    plan = O.in_time(L.rated_events(stream), L.PLACE_KEYS, O.PLACE_EVENT, "10 minutes")._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
