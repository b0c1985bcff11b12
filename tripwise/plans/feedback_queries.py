"""Feedback state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import feedback as B
from tripwise.operators.population import behavior_coefficients
from tripwise.plans.ranking_queries import KEYS, places
from tripwise.plans.population_queries import COEF
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import sql_u


@query("footfall", "SELECT place_id, count(*) AS visits FROM f_feedback WHERE kind = 'visit' GROUP BY place_id")
def footfall(t):
    return B.footfall(t.feedback.where(F.col("kind") == "visit")).select("place_id", "visits")


DYN = """d AS (SELECT p.place_id, p.rating, p.review_count, count(f.event_id) FILTER (kind = 'like') AS likes, count(f.event_id) FILTER (kind = 'dislike') AS dislikes,
 count(f.event_id) FILTER (kind = 'visit') AS visits FROM f_places p LEFT JOIN f_feedback f USING (place_id) GROUP BY ALL)"""
LIVE = "CASE WHEN likes + dislikes = 0 THEN rating ELSE greatest(1e0, least(5e0, (rating * 20 + 5 * likes + dislikes) / (20 + likes + dislikes))) END"


@query("bayesian_rating", f"WITH {DYN} SELECT place_id, likes, dislikes, round({LIVE}, 9) AS live_rating FROM d")
def bayesian_rating(t):
    return rounded(B.place_dynamics(t.places, t.feedback).select("place_id", "likes", "dislikes", "live_rating"), 9)


@query("review_count", f"WITH {DYN} SELECT place_id, review_count + likes + dislikes AS live_reviews, visits FROM d")
def review_count(t):
    return B.place_dynamics(t.places, t.feedback).select("place_id", "live_reviews", "visits")


DELTA = "CASE kind WHEN 'like' THEN 1 ELSE -1 END * 0.12e0 * greatest(0.2e0, least(2e0, strength))"
FOLD = "list_reduce(list_prepend(0e0, list(d ORDER BY {o})), lambda a, x: greatest(-1e0, least(1e0, a + x)))"


@query("place_affinity", f"""SELECT source, user_id, place_id, round({FOLD.format(o='ts, event_id')}, 9) AS aff FROM (SELECT *, {DELTA} AS d FROM f_feedback WHERE kind <> 'visit') GROUP BY ALL""")
def place_affinity(t):
    return rounded(B.place_affinity(t.feedback, t.places), 9)


@query("keyword_affinity", f"""SELECT source, user_id, keyword, round({FOLD.format(o='ts, event_id')}, 9) AS aff FROM (SELECT f.*, {DELTA} * 0.7e0 AS d, unnest(keywords) AS keyword FROM f_feedback f
 JOIN f_places USING (place_id) JOIN {KEYS} USING (category) WHERE kind <> 'visit') GROUP BY ALL""")
def keyword_affinity(t):
    return rounded(B.keyword_affinity(t.feedback, places(t)), 9)


def rated(t):
    """Trips with their agent's traits."""
    agents = behavior_coefficients(t.agents).select(
        "agent_id", "intrinsic", "escape", "travel_affinity", "trust_platforms", "feedback_loop_strength", "autonomy_preference",
        "algorithmic_awareness", "feedback_sensitivity", (F.lit(0.7) + (F.col("agent_id") % 13) * 0.05).alias("pref"))
    return t.trips.join(agents, "agent_id").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400 + F.col("depart") * 60))


LIKE = f"""{COEF}, s AS (SELECT t.*, b.feedback_sensitivity AS sens, (0.85e0 * activity_utility + 0.25e0 * travel_utility + 0.3e0 * (0.7e0 + (b.agent_id % 13) * 0.05e0 - 1) + 0.2e0 * intrinsic + 0.1e0 * escape
  + 0.15e0 * travel_affinity + 0.16e0 * (trust_platforms - 0.5e0) + 0.12e0 * (feedback_loop_strength - 0.5e0) - 0.1e0 * (autonomy_preference - 0.5e0) - 0.08e0 * (algorithmic_awareness - 0.5e0)
  + CASE WHEN subtype IN ('park', 'workout_or_run') THEN -0.25e0 ELSE 0e0 END + CASE WHEN subtype = 'park' THEN 0.1e0 ELSE 0e0 END) * (1 + 0.25e0 * (b.feedback_sensitivity - 1)) AS score
  FROM f_trips t JOIN b USING (agent_id)),
 p AS (SELECT *, CASE WHEN purpose = 'leisure' AND accepted THEN greatest(0.05e0, least(0.95e0, 1 / (1 + exp(-1.25e0 * score)))) ELSE 0e0 END AS p_like FROM s)"""
CONTEXT = dict(weather="rain", social_norms="green")


@query("like_probability", f"WITH {LIKE} SELECT trip_key, round(p_like, 9) AS p_like FROM p")
def like_probability(t):
    return rounded(rated(t).select("trip_key", B.like_probability(**CONTEXT).alias("p_like")), 9)


RATED = f"""{LIKE}, r AS (SELECT *, {sql_u('CAST(trip_key AS VARCHAR)', "'like'")} < p_like AS liked_now, greatest(0.2e0, least(2e0, greatest(0.25e0, abs(2 * p_like - 1) * sens))) AS strength,
 greatest(-1e0, least(1e0, (2 * p_like - 1) * greatest(0.2e0, least(2e0, sens)))) AS satisfaction, cost + travel_min / 60e0 * 15 AS realized, activity_utility + travel_utility AS net FROM p WHERE purpose = 'leisure' AND accepted)"""


@query("continuous_feedback", f"WITH {RATED} SELECT trip_key, round(satisfaction, 9) AS satisfaction, round(realized, 9) AS realized_travel_cost, round(net, 9) AS net_utility FROM r")
def continuous_feedback(t):
    return rounded(B.rate_trips(rated(t), **CONTEXT).select("trip_key", "satisfaction", "realized_travel_cost", "net_utility"), 9)


@query("feedback_strength", f"WITH {RATED} SELECT trip_key, liked_now AS \"like\", round(strength, 9) AS strength FROM r")
def feedback_strength(t):
    return rounded(B.rate_trips(rated(t), **CONTEXT).select("trip_key", "like", "strength"), 9)


def sql_cost_state(source: str) -> str:
    """Sequential walk over each user's events."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {source}),
 walk(user_id, i, vot, ema) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 15e0, 0e0 FROM ord UNION ALL
  SELECT o.user_id, o.i, CASE WHEN travel_min > 0 AND satisfaction < -0.2e0 THEN least(50e0, w.vot * (1 + 0.05e0 * abs(satisfaction)))
    WHEN travel_min > 20 AND satisfaction > 0.3e0 THEN greatest(5e0, w.vot * (1 - 0.03e0 * satisfaction)) ELSE w.vot END,
   0.85e0 * w.ema + 0.15e0 * (money + travel_min / 60e0 * w.vot) FROM walk w JOIN ord o ON o.user_id = w.user_id AND o.i = w.i + 1),
 fin AS (SELECT user_id, max(i) AS n, max_by(ema, i) AS ema, max_by(vot, i) AS vot FROM walk GROUP BY user_id)"""


@query("travel_cost_state", f"WITH RECURSIVE {sql_cost_state('f_feedback')} SELECT user_id, n, round(ema, 6) AS avg_travel_cost, round(vot, 6) AS vot FROM fin")
def travel_cost_state(t):
    return rounded(B.travel_cost_state(t.feedback))


@query("match_feedback_trip", """WITH RECURSIVE ev AS (SELECT agent_id, place_id % 3 AS place_id, day * 1440 + depart AS t, CAST(0 AS BIGINT) AS kind, trip_key AS id FROM f_trips WHERE purpose = 'leisure'
   UNION ALL SELECT agent_id, place_id % 3, day * 1440 + arrival + 60, 1, trip_key FROM f_trips WHERE purpose <> 'work'),
  o AS (SELECT *, row_number() OVER (PARTITION BY agent_id, place_id ORDER BY t, kind, id) AS i FROM ev),
  w(agent_id, place_id, i, open, feedback_id, trip_key) AS (SELECT DISTINCT agent_id, place_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
   UNION ALL SELECT o.agent_id, o.place_id, o.i, CASE WHEN o.kind = 0 THEN list_append(w.open, o.id) ELSE w.open[1:len(w.open) - 1] END, CASE WHEN o.kind = 1 THEN o.id END,
    CASE WHEN o.kind = 1 AND len(w.open) > 0 THEN w.open[len(w.open)] END FROM w JOIN o ON o.agent_id = w.agent_id AND o.place_id = w.place_id AND o.i = w.i + 1)
  SELECT agent_id, place_id, feedback_id, trip_key FROM w WHERE feedback_id IS NOT NULL""")
def match_feedback_trip(t):
    c = F.col
    place = (c("place_id") % 3).alias("place_id")
    trips = t.trips.where(c("purpose") == "leisure").select("agent_id", place, (c("day") * 1440 + c("depart")).alias("t"), "trip_key")
    rated_ = t.trips.where(c("purpose") != "work").select("agent_id", place, (c("day") * 1440 + c("arrival") + 60).alias("t"), c("trip_key").alias("feedback_id"))
    return B.match_feedback_trip(trips, rated_, F.floor(c("t") / 60))


@query("reference_points", """SELECT agent_id, round(list_reduce(list_prepend(any_value(ref_time), list(CAST(travel_min AS DOUBLE) ORDER BY day, depart, trip_key) FILTER (trip_key IS NOT NULL)), lambda a, x: 0.8e0 * a + 0.2e0 * x), 9) AS ref_time,
 round(list_reduce(list_prepend(any_value(ref_cost), list(cost ORDER BY day, depart, trip_key) FILTER (trip_key IS NOT NULL)), lambda a, x: 0.8e0 * a + 0.2e0 * x), 9) AS ref_cost FROM f_agents LEFT JOIN f_trips USING (agent_id) GROUP BY agent_id""")
def reference_points(t):
    return rounded(B.reference_points(t.trips, t.agents, F.col("day") * 24 + F.floor(F.col("depart") / 60)), 9)


@query("accepted_memory", """SELECT trip_key, CAST(coalesce(sum(CAST(accepted AS INT)) OVER (PARTITION BY treatment, seed, agent_id ORDER BY day, depart, trip_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_accepted FROM f_trips""")
def accepted_memory(t):
    return memory(t).select("trip_key", "n_accepted")


def memory(t):
    return B.accepted_memory(t.trips, ["treatment", "seed", "agent_id"], ["day", "depart", "trip_key"], F.struct("day", F.floor(F.col("depart") / 60).alias("h")))


@query("apply_feedback", f"""WITH RECURSIVE {RATED}, ev AS (SELECT trip_key AS event_id, agent_id AS user_id, day * 1440 + depart AS ts, place_id, source, strength, liked_now, cost AS money, travel_min, satisfaction FROM r),
 {sql_cost_state('ev')}, pa AS (SELECT user_id, sum(aff) AS aff_sum, count(*) AS n_places FROM (SELECT source, user_id, place_id,
   {FOLD.format(o='ts, event_id')} AS aff FROM (SELECT *, CASE WHEN liked_now THEN 1 ELSE -1 END * 0.12e0 * greatest(0.2e0, least(2e0, strength)) AS d FROM ev) GROUP BY ALL) GROUP BY user_id)
 SELECT user_id, n, round(ema, 6) AS avg_travel_cost, round(vot, 6) AS vot, round(aff_sum, 6) AS aff_sum, n_places FROM fin JOIN pa USING (user_id)""")
def apply_feedback(t):
    """State of every user after all rated trips."""
    effects = B.apply_feedback(rated(t), places(t), **CONTEXT)
    own = effects["place_affinity"].groupBy("user_id").agg(F.sum("aff").alias("aff_sum"), F.count(F.lit(1)).alias("n_places"))
    return rounded(effects["travel_cost"].join(own, "user_id"))
