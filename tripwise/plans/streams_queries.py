"""Streaming jobs, run over the event files until everything is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise.plans.feedback_queries import DELTA, FOLD, KEYS, places, sql_cost_state
from tripwise.plans.registry import query, rounded
from tripwise.plans.tables import VIEWS
from tripwise.streaming import jobs as L

c = F.col


def feedback_stream(t):
    """The feedback view over a stream of event files."""
    events = L.read_events(t.spark, f"{t.folder}/events*.parquet")
    return t.spark.sql(VIEWS["f_feedback"], events=events, part=t.part)


@query("stream_place_dynamics", """SELECT place_id, count(*) FILTER (kind = 'visit') AS visits, count(*) FILTER (kind = 'like') AS likes, count(*) FILTER (kind = 'dislike') AS dislikes FROM f_feedback GROUP BY place_id""")
def stream_place_dynamics(t):
    out, checkpoint = L.folders(t.spark, "place-dynamics")
    L.run_updates(L.place_counters(feedback_stream(t)), out, checkpoint, ["place_id"])
    return L.latest(t.spark, out, ["place_id"])


@query("stream_tick_series", "SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS tick, kind, count(*) AS n FROM f_feedback GROUP BY ALL")
def stream_tick_series(t):
    out, checkpoint = L.folders(t.spark, "ticks")
    L.run_updates(L.tick_counts(feedback_stream(t)), out, checkpoint, ["tick", "kind"])
    return L.latest(t.spark, out, ["tick", "kind"]).withColumn("tick", F.unix_timestamp("tick"))


@query("stream_visits_sliding", """SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) - 300 * i AS since, place_id, count(*) AS visits
 FROM f_feedback, (SELECT range AS i FROM range(0, 12)) WHERE kind = 'visit' GROUP BY ALL""")
def stream_visits_sliding(t):
    out, checkpoint = L.folders(t.spark, "sliding")
    L.run_updates(L.sliding_visits(feedback_stream(t)), out, checkpoint, L.PANE_KEYS, mode="append")
    both = L.latest(t.spark, out, L.PANE_KEYS).unionByName(L.open_windows(t.spark, checkpoint))
    return both.withColumn("since", F.unix_timestamp("since"))


@query("stream_affinity", f"""SELECT source, user_id, place_id, round({FOLD.format(o='ts, event_id')}, 9) AS aff FROM (SELECT *, {DELTA} AS d FROM f_feedback WHERE kind <> 'visit') GROUP BY ALL""")
def stream_affinity(t):
    out, checkpoint = L.folders(t.spark, "affinity")
    L.stream_affinity(feedback_stream(t), out, checkpoint)
    return rounded(L.with_tail(t.spark, checkpoint, L.PLACE_KEYS, L.affinity_fold), 9)


@query("stream_keyword_affinity", f"""SELECT source, user_id, keyword, round({FOLD.format(o='ts, event_id')}, 9) AS aff FROM (SELECT f.*, {DELTA} * 0.7e0 AS d, unnest(keywords) AS keyword FROM f_feedback f
 JOIN f_places USING (place_id) JOIN {KEYS} USING (category) WHERE kind <> 'visit') GROUP BY ALL""")
def stream_keyword_affinity(t):
    out, checkpoint = L.folders(t.spark, "keyword-affinity")
    L.stream_keyword_affinity(feedback_stream(t), places(t), out, checkpoint)
    return rounded(L.with_tail(t.spark, checkpoint, L.WORD_KEYS, L.keyword_fold), 9)


@query("stream_travel_cost", f"WITH RECURSIVE ev AS (SELECT * FROM f_feedback), {sql_cost_state('ev')} SELECT user_id, n, round(ema, 6) AS avg_travel_cost, round(vot, 6) AS vot FROM fin")
def stream_travel_cost(t):
    out, checkpoint = L.folders(t.spark, "travel-cost")
    L.stream_travel_cost(feedback_stream(t), out, checkpoint)
    return rounded(L.with_tail(t.spark, checkpoint, ["user_id"], L.travel_cost_fold))
