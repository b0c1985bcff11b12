"""Streaming jobs over feedback and trip events (event_id, ts, user_id, ...).

Counters commute, so those jobs are plain streaming aggregates.  Affinities and
travel costs depend on order: their events wait in the state store until the
watermark has passed (``ordered``), and every micro-batch folds those that are due onto the
logged states of their keys.  Every job writes the rows that changed to an update
log; the log is folded into a base table now and then, so that readers and folders stay
small.  Nothing waits in driver memory, and a batch that runs again after a
failure rewrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import feedback as B
from tripwise.streaming import ordered as O
from tripwise.session import scratch_path


def event_time(df: DataFrame) -> DataFrame:
    """Time stamps without zone are rejected by watermarks; the session zone is UTC."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; ``path`` is a folder or a pattern."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# ------------------------------------------------------------------ aggregates
def place_counters(events: DataFrame) -> DataFrame:
    """Running visits, likes and dislikes per place; late events do no harm."""
    return events.groupBy("place_id").agg(*[
        F.sum((F.col("kind") == k).cast("long")).alias(f"{k}s") for k in ("visit", "like", "dislike")])


def tick_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events per five-minute tick and kind."""
    return event_time(events).withWatermark("ts", delay).groupBy(F.window("ts", f"{P.TICK_MINUTES} minutes").alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("tick"), "kind", "n")


PANE_KEYS = ["since", "place_id"]


def sliding_visits(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """Footfall per place over a sliding window, for trending lists: windows that are closed.

    Visits are counted once, in panes as long as the step; the sliding windows are a second
    aggregate over finished panes.  So state and shuffle hold a row per pane and place, not
    one per event and window.  ``width`` is a multiple of ``step``.
    """
    visits = event_time(events).where(F.col("kind") == "visit").withWatermark("ts", delay)
    panes = visits.groupBy(F.window("ts", step).alias("pane"), "place_id").agg(F.count(F.lit(1)).alias("n"))
    windows = panes.groupBy(F.window(F.window_time("pane"), width, step).alias("w"), "place_id").agg(F.sum("n").alias("visits"))
    return windows.select(F.col("w.start").alias("since"), "place_id", "visits")


def open_windows(spark: SparkSession, checkpoint: str, width_minutes: int = 60, step_minutes: int = 5) -> DataFrame:
    """Counts so far of the sliding windows that are not closed yet, from both aggregates' state."""
    states = [spark.read.format("statestore").option("path", checkpoint).option("operatorId", i).load() for i in (0, 1)]
    length = lambda s, name: F.unix_timestamp(s["key"][name]["end"]) - F.unix_timestamp(s["key"][name]["start"])
    name = {i: next(f.name for f in s.schema["key"].dataType.fields if f.name != "place_id") for i, s in enumerate(states)}
    rows = [s.select(F.col("key")[name[i]]["start"].alias("start"), length(s, name[i]).alias("seconds"), F.col("key")["place_id"].alias("place_id"),
                     F.col("value")[s.schema["value"].dataType.names[0]].alias("n")) for i, s in enumerate(states)]
    both = rows[0].unionByName(rows[1])
    windows = both.where(F.col("seconds") == width_minutes * 60).select(F.col("start").alias("since"), "place_id", F.col("n").alias("visits"))
    back = F.explode(F.sequence(F.lit(0), F.lit(width_minutes - step_minutes), F.lit(step_minutes)))
    panes = both.where(F.col("seconds") == step_minutes * 60).select("start", "place_id", F.col("n").alias("visits"), back.alias("back"))
    panes = panes.select((F.col("start") - F.make_dt_interval(mins=F.col("back"))).alias("since"), "place_id", "visits")
    return windows.unionByName(panes).groupBy("since", "place_id").agg(F.sum("visits").alias("visits"))


# ------------------------------------------------------------------ the update log
def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def parts(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the finished tables ``folder/<kind>=<n>``, in order."""
    path = _path(spark, folder)
    fs = _fs(spark, path)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in found if p.getName().startswith(f"{kind}=") and fs.exists(_path(spark, f"{p}/_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _log(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame | None:
    """Rows of the newest base table and of the batches after it, with their ``batch``."""
    bases = [b for b in parts(spark, folder, "base") if until is None or b < until]
    base = bases[-1] if bases else -1
    batches = [b for b in parts(spark, folder, "batch") if b > base and (until is None or b <= until)]
    tables = [spark.read.parquet(f"{folder}/batch={b}").withColumn("batch", F.lit(b).cast("bigint")) for b in batches]
    if base >= 0:
        tables.append(spark.read.parquet(f"{folder}/base={base}").withColumn("batch", F.lit(base).cast("bigint")))
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out


def _newest(log: DataFrame, keys: list[str]) -> DataFrame:
    row = F.struct(*[c for c in log.columns if c not in (*keys, "batch")])
    return log.groupBy(*keys).agg(F.max_by(row, "batch").alias("_r")).select(*keys, "_r.*")


def compact(spark: SparkSession, folder: str, keys: list[str], n: int) -> None:
    """Fold the log up to batch n into ``base=<n>``.  What the base before that one covers
    is deleted: batch n may run again and needs its own predecessors only."""
    log = _log(spark, folder, n)
    if log is None:
        return
    earlier = [b for b in parts(spark, folder, "base") if b < n]
    _newest(log, keys).write.mode("overwrite").parquet(f"{folder}/base={n}")
    if earlier:
        old = [f"base={b}" for b in earlier[:-1]] + [f"batch={b}" for b in parts(spark, folder, "batch") if b <= earlier[-1]]
        for name in old:
            path = _path(spark, f"{folder}/{name}")
            _fs(spark, path).delete(path, True)


def run_updates(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], mode: str = "update", compact_every: int = 20,
                change: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Write the changed rows of every micro-batch to ``folder/batch=<n>``, and every
    ``compact_every`` batches the newest row of each key to ``folder/base=<n>``.
    ``change(batch, n)`` makes the rows to be written of those of the stream."""
    spark = stream.sparkSession

    def save(batch: DataFrame, n: int) -> None:
        rows = batch if change is None else change(batch, n)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        if n % compact_every == compact_every - 1:
            compact(spark, folder, keys, n)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """Current value per key: the row of the last batch that changed it; none before the first batch."""
    log = _log(spark, folder)
    return None if log is None else _newest(log, keys)


# ------------------------------------------------------------------ order-dependent state
@contextmanager
def state_store(spark: SparkSession, provider: str = O.ROCKSDB) -> Iterator[None]:
    """The store that holds more keys than memory; the session's own setting comes back."""
    before = spark.conf.get(O.PROVIDER, None)
    spark.conf.set(O.PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.unset(O.PROVIDER) if before is None else spark.conf.set(O.PROVIDER, before)


Fold = Callable[[DataFrame, "DataFrame | None"], DataFrame]


def same_key(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``a`` joined with ``b`` on equal keys; null is a key like any other."""
    other = b.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    return a.join(other, on, how)


def run_ordered(events: DataFrame, keys: list[str], event: str, fold: Fold, folder: str, checkpoint: str, delay: str, compact_every: int = 20) -> None:
    """Fold the events of every key in their order and log the states that changed.

    A batch reads the log before it, so running it again gives the same rows.  The place of the
    log is written beside the checkpoint, for readers of both.
    """
    spark = events.sparkSession

    def change(batch: DataFrame, n: int) -> DataFrame:
        # written once: a fold reads its events several times, the state store must be asked once
        path = f"{folder}/due=0"
        batch.write.mode("overwrite").parquet(path)
        due = O.copies(spark.read.schema(batch.schema).parquet(path))
        log = _log(spark, folder, n - 1)
        state = None if log is None else _newest(same_key(log, due.select(*keys).distinct(), keys, "left_semi"), keys)
        return fold(due, state)

    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("overwrite").text(f"{checkpoint}/log")
    with state_store(spark):
        run_updates(O.in_time(events, keys, event, delay), folder, checkpoint, keys, mode="append", compact_every=compact_every, change=change)


def folded(events: DataFrame, state: DataFrame | None, keys: list[str], fold: Fold) -> DataFrame:
    """The state after some more events."""
    new = fold(events, state)
    return new if state is None else new.unionByName(same_key(state, new.select(*keys), keys, "left_anti"))


def _committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The last finished batch of a job."""
    path = _path(spark, f"{checkpoint}/commits")
    fs = _fs(spark, path)
    done = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in done if n.isdigit()), default=None)


def with_tail(spark: SparkSession, checkpoint: str, keys: list[str], fold: Fold) -> DataFrame | None:
    """The state of every key with the events on top that still wait for the watermark, for
    readers that want everything seen so far.  The log and the state store stay as they are, so
    the stream goes on without a gap.  None before the first batch."""
    last = _committed(spark, checkpoint)
    if last is None or not _fs(spark, _path(spark, checkpoint)).exists(_path(spark, f"{checkpoint}/log")):
        return None
    log = _log(spark, spark.read.text(f"{checkpoint}/log").first()[0], last)
    return folded(O.held_events(spark, checkpoint), None if log is None else _newest(log, keys), keys, fold)


PLACE_KEYS = ["source", "user_id", "place_id"]
WORD_KEYS = ["source", "user_id", "keyword"]


def affinity_fold(events: DataFrame, state: DataFrame | None) -> DataFrame:
    """Clamped additions per (source, user, place) on top of the state."""
    return B.clamped_fold(events, PLACE_KEYS, ["ts", "event_id"], B.ts_bucket(), initial=state)


def keyword_fold(events: DataFrame, state: DataFrame | None) -> DataFrame:
    """Clamped additions per (source, user, key word) on top of the state."""
    return B.clamped_fold(events, WORD_KEYS, ["ts", "event_id", "pos"], B.ts_bucket(), initial=state)


def rated_events(events: DataFrame) -> DataFrame:
    """Likes and dislikes with their signed step."""
    rated = events.where(F.col("kind").isin("like", "dislike") & F.col("source").isin(*B.SOURCES))
    return rated.withColumn("delta", B.signed_delta(F.col("kind") == "like", F.col("strength")))


def rated_words(events: DataFrame, places: DataFrame) -> DataFrame:
    """Discounted steps for every key word of the rated place.  Places are joined by sorting: Spark
    sees the key words as far smaller than they are, and a stream's plan is never corrected."""
    rows = rated_events(events).join(places.select("place_id", "keywords").hint("merge"), "place_id").select(
        "source", "user_id", "ts", "event_id", (F.col("delta") * P.FEEDBACK["keyword_discount"]).alias("delta"), F.posexplode("keywords").alias("pos", "word"))
    return rows.withColumn("keyword", F.lower("word")).drop("word")


def travel_cost_fold(events: DataFrame, state: DataFrame | None) -> DataFrame:
    """Travel-cost state per user on top of the state."""
    return B.travel_cost_state(events, initial=state)


def stream_affinity(events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes") -> None:
    run_ordered(rated_events(events), PLACE_KEYS, O.PLACE_EVENT, affinity_fold, folder, checkpoint, delay)


def stream_keyword_affinity(events: DataFrame, places: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes") -> None:
    run_ordered(rated_words(events, places), WORD_KEYS, O.WORD_EVENT, keyword_fold, folder, checkpoint, delay)


def stream_travel_cost(events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes") -> None:
    run_ordered(events, ["user_id"], O.COST_EVENT, travel_cost_fold, folder, checkpoint, delay)


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders under the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
