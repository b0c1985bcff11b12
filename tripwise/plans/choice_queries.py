"""Discrete choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import draw_index, hash_uniform
from tripwise.operators import choice as H
from tripwise.operators.population import behavior_coefficients, mode_bias
from tripwise.plans.feedback_queries import memory
from tripwise.plans.population_queries import COEF, sql_bias
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import sql_u

c = F.col


def trip_rows(t):
    """Trips with everything a mode choice looks at."""
    agents = mode_bias(behavior_coefficients(t.agents)).drop("paradigm")
    paradigm = t.agents.select("agent_id", "paradigm")
    trips = t.trips.select(
        "trip_key", "agent_id", "distance_km", c("purpose").alias("next_purpose"), c("subtype").alias("next_subtype"),
        (c("purpose") != "leisure").alias("mandatory"), (c("trip_key") % 90).alias("road_volume"), (c("trip_key") % 150).alias("transit_volume"),
        (0.2 + (c("trip_key") % 8) * 0.1).alias("peer_status"))
    return H.bpr_congestion(trips.join(agents, "agent_id").join(paradigm, "agent_id"), 60.0, 120.0)


CONTEXT = dict(weather="rain", policy="congestion_pricing", social_norms="green")
MODES = "(VALUES " + ", ".join(
    f"('{m}', {i}, {P.MODE_TABLE[m]['speed'] * P.WEATHER_SPEED['rain'][m]!r}::DOUBLE, {v['per_km']}e0, {v['fixed']}e0, {v['g_km']}e0, {v['wait']}e0, {v['comfort']}e0, {v['status']}e0, {v['enjoyment']}e0, {v['community']}e0)"
    for i, (m, v) in enumerate(P.MODE_TABLE.items())) + ") m(mode, pos, speed, per_km, fixed, g_km, wait, comfort, status, enjoyment, community)"
TASTE = "CASE " + " ".join(f"WHEN subtype = '{s}' AND mode = '{m}' THEN {v}e0" for s, d in P.MODE_TASTE.items() for m, v in d.items()) + " ELSE 0e0 END"
SEGU = "CASE subtype " + " ".join(f"WHEN '{s}' THEN {v['utility']}e0" for s, v in P.SEGMENTS.items()) + " ELSE 0e0 END"
ROWS = f"""{COEF}, bb AS (SELECT *, {', '.join(sql_bias(m).replace('round(', '(').replace(', 9)', ')') for m in P.MODES)} FROM b),
 rows AS (SELECT bb.*, t.trip_key, t.distance_km, t.purpose, t.subtype, 1 + 0.15e0 * (t.trip_key % 90 / 60e0) ** 4 AS road_factor, 1 + 0.25e0 * (t.trip_key % 150 / 120e0) ** 2 AS crowd_factor,
  0.2e0 + (t.trip_key % 8) * 0.1e0 AS peer FROM f_trips t JOIN bb USING (agent_id)),
 av AS (SELECT *, CASE mode WHEN 'car' THEN CASE car_access WHEN 'own car' THEN TRUE WHEN 'carshare' THEN distance_km >= 1.5e0 ELSE distance_km >= 3 END
   WHEN 'bike' THEN age <= 75 AND mobility_needs = 'none' AND distance_km <= 12
   WHEN 'walk' THEN age <= 85 AND distance_km <= CASE WHEN mobility_needs = 'none' THEN greatest(0.5e0, walk_tolerance / 12e0) ELSE least(1e0, greatest(0.5e0, walk_tolerance / 12e0)) END
   ELSE TRUE END AS available FROM rows, {MODES}),
 o1 AS (SELECT *, distance_km / speed * 60 * CASE mode WHEN 'car' THEN road_factor WHEN 'transit' THEN crowd_factor ELSE 1e0 END + wait AS minutes,
   fixed + per_km * distance_km + CASE WHEN mode = 'car' THEN 2 + 0.15e0 * distance_km ELSE 0e0 END AS money, g_km * distance_km AS emissions_g FROM av WHERE available),
 o2 AS (SELECT *, minutes / 60 * vot * pref_time + money * pref_cost AS gen_cost FROM o1),
 o AS (SELECT *, -gen_cost / 8 + comfort * pref_comfort - pref_green * 1.25e0 * emissions_g / 1000 - CASE WHEN purpose <> 'leisure' THEN 0.05e0 * derived * minutes / 10 ELSE 0e0 END
   + intrinsic * enjoyment * minutes / 30 + CASE WHEN purpose = 'leisure' THEN escape * least(1.5e0, distance_km / 5) + {TASTE} ELSE 0e0 END
   + positionality * status_seeking * (status - peer) + community * practice_conformity
   + CASE mode WHEN 'walk' THEN bias_walk WHEN 'bike' THEN bias_bike WHEN 'transit' THEN bias_transit ELSE bias_car - car_penalty END
   + CASE WHEN purpose = 'leisure' THEN {SEGU} + 0.3e0 * intrinsic + 0.15e0 * escape ELSE 0e0 END AS utility FROM o2)"""


def options(t):
    return H.evaluate_modes(trip_rows(t), **CONTEXT)


@query("mode_availability", f"WITH {ROWS} SELECT trip_key, mode FROM av WHERE available")
def mode_availability(t):
    return options(t).select("trip_key", F.explode("options.mode").alias("mode"))


@query("mode_outcome", f"WITH {ROWS} SELECT trip_key, mode, round(minutes + 1.7e-8, 6) AS minutes, round(money + 1.7e-8, 6) AS money, round(gen_cost + 1.7e-8, 6) AS gen_cost, round(emissions_g, 6) AS emissions_g, round(utility + 1.7e-8, 6) AS utility FROM o")
def mode_outcome(t):
    rows = options(t).select("trip_key", F.explode("options").alias("o"))
    # the inputs are short decimals: a small offset keeps values off rounding ties
    off = [(c(f"o.{x}") + 1.7e-8).alias(x) for x in ("minutes", "money", "gen_cost", "utility")]
    return rounded(rows.select("trip_key", "o.mode", "o.emissions_g", *off))


U = sql_u("CAST(trip_key AS VARCHAR)", "'mode'")
PROBS = "pb AS (SELECT *, w / sum(w) OVER (PARTITION BY trip_key) AS p, sum(w) OVER (PARTITION BY trip_key ORDER BY pos) AS run, sum(w) OVER (PARTITION BY trip_key) AS tot FROM (SELECT *, exp(utility - max(utility) OVER (PARTITION BY trip_key)) AS w FROM o))"
DRAW = f"{PROBS}, ch AS (SELECT trip_key, min_by(mode, pos) AS by_utility FROM pb WHERE run > {U} * tot GROUP BY trip_key)"


@query("weighted_choice", f"""WITH w AS (SELECT place_id, rating AS a, popularity / 1000 AS b, review_count / 1000e0 AS d, {sql_u("CAST(place_id AS VARCHAR)", "'pick'")} AS u FROM f_places)
 SELECT place_id, CASE WHEN a > u * (a + b + d) THEN 1 WHEN a + b > u * (a + b + d) THEN 2 ELSE 3 END AS pick FROM w""")
def weighted_choice(t):
    weights = F.array(c("rating"), c("popularity") / 1000, c("review_count") / 1000.0)
    return t.places.select("place_id", draw_index(weights, hash_uniform(c("place_id").cast("string"), "pick")).alias("pick"))


@query("choose_utility", f"WITH {ROWS}, {DRAW} SELECT trip_key, mode, round(p, 9) AS p, by_utility AS drawn FROM pb JOIN ch USING (trip_key)")
def choose_utility(t):
    rows = options(t)
    u = hash_uniform(c("trip_key").cast("string"), "mode")
    rows = rows.select("trip_key", H.choose_utility(c("options"), u).alias("drawn"), "options", H.choice_probabilities(c("options")).alias("ps"))
    pairs = rows.select("trip_key", "drawn", F.explode(F.arrays_zip("options.mode", "ps")).alias("z"))
    return rounded(pairs.select("trip_key", c("z.mode").alias("mode"), c("z.ps").alias("p"), "drawn"), 9)


REGRET = "rg AS (SELECT a.trip_key, a.mode, a.pos, sum(greatest(0e0, b.gen_cost - a.gen_cost)) AS r FROM o a JOIN o b USING (trip_key) GROUP BY ALL), rc AS (SELECT trip_key, arg_min(mode, (r, pos)) AS by_regret FROM rg GROUP BY trip_key)"
PROSPECT = "pc AS (SELECT trip_key, arg_min(mode, (-(utility + (greatest(0e0, ref_time - minutes) / 60 * vot + greatest(0e0, ref_cost - money) - loss_aversion * (greatest(0e0, minutes - ref_time) / 60 * vot + greatest(0e0, money - ref_cost))) / 8), pos)) AS by_prospect FROM o GROUP BY trip_key)"
SATISF = "sc AS (SELECT trip_key, min_by(mode, pos) FILTER (gen_cost <= satisficing_threshold) AS by_threshold FROM o GROUP BY trip_key)"
HABIT = "hc AS (SELECT trip_key, max(habit_mode) FILTER (mode = habit_mode) AS by_habit FROM o GROUP BY trip_key)"


@query("choose_regret", f"WITH {ROWS}, {REGRET} SELECT trip_key, by_regret AS mode FROM rc")
def choose_regret(t):
    return options(t).select("trip_key", H.choose_regret(c("options")).alias("mode"))


@query("choose_prospect", f"WITH {ROWS}, {PROSPECT} SELECT trip_key, by_prospect AS mode FROM pc")
def choose_prospect(t):
    return options(t).select("trip_key", H.choose_prospect(c("options")).alias("mode"))


@query("choose_satisficing", f"WITH {ROWS}, {DRAW}, {SATISF} SELECT trip_key, coalesce(by_threshold, by_utility) AS mode FROM sc JOIN ch USING (trip_key)")
def choose_satisficing(t):
    u = hash_uniform(c("trip_key").cast("string"), "mode")
    return options(t).select("trip_key", H.choose_satisficing(c("options"), c("satisficing_threshold"), u).alias("mode"))


@query("choose_habit", f"WITH {ROWS}, {DRAW}, {HABIT} SELECT trip_key, coalesce(by_habit, by_utility) AS mode FROM hc JOIN ch USING (trip_key)")
def choose_habit(t):
    u = hash_uniform(c("trip_key").cast("string"), "mode")
    return options(t).select("trip_key", H.choose_habit(c("options"), c("habit_mode"), u).alias("mode"))


@query("dispatch_paradigm", f"""WITH {ROWS}, {DRAW}, {REGRET}, {PROSPECT}, {SATISF}, {HABIT} SELECT trip_key, CASE paradigm WHEN 'regret' THEN by_regret WHEN 'prospect' THEN by_prospect
  WHEN 'satisficing' THEN coalesce(by_threshold, by_utility) WHEN 'habit' THEN coalesce(by_habit, by_utility) ELSE by_utility END AS chosen_mode
 FROM (SELECT trip_key, paradigm FROM rows) JOIN ch USING (trip_key) JOIN rc USING (trip_key) JOIN pc USING (trip_key) JOIN sc USING (trip_key) JOIN hc USING (trip_key)""")
def dispatch_paradigm(t):
    return H.dispatch_paradigm(options(t), car_only=False).select("trip_key", "chosen_mode")


@query("bpr_congestion", "SELECT trip_key, round(1 + 0.15e0 * (trip_key % 90 / 60e0) ** 4, 12) AS road_factor, round(1 + 0.25e0 * (trip_key % 150 / 120e0) ** 2, 12) AS crowd_factor FROM f_trips")
def bpr_congestion(t):
    rows = t.trips.select("trip_key", (c("trip_key") % 90).alias("road_volume"), (c("trip_key") % 150).alias("transit_volume"))
    return rounded(H.bpr_congestion(rows, 60.0, 120.0).select("trip_key", "road_factor", "crowd_factor"), 12)


TPB = """(1 / (1 + exp(-(1.3e0 * (travel_affinity + 0.1e0 * intrinsic) + 0.9e0 * 0.8e0 + 0.8e0 * greatest(0e0, least(1e0, 0.1e0 + CASE car_access WHEN 'own car' THEN 0.4e0 WHEN 'carshare' THEN 0.18e0 ELSE 0e0 END
 + 0.25e0 * (transit_level - 0.5e0) + CASE WHEN age > 75 THEN -0.1e0 ELSE 0e0 END + CASE WHEN mobility_needs = 'none' THEN 0e0 ELSE -0.08e0 END)) - 1))))"""


@query("tpb_intention", f"SELECT agent_id, round({TPB}, 9) AS intention FROM f_agents")
def tpb_intention(t):
    return rounded(t.agents.select("agent_id", H.tpb_intention("leisure", "pro_travel").alias("intention")), 9)


def plan_rows(t):
    rows = H.explode_subtypes(behavior_coefficients(t.agents))
    i = c("subtype_pos")
    return rows.withColumns({
        "work_end": (900 + (c("agent_id") * 7) % 180).cast("long"), "d_out": ((c("agent_id") * (i + 3)) % 41) * 0.1,
        "d_back": ((c("agent_id") * (i + 5)) % 37) * 0.1, "pref": 0.7 + ((c("agent_id") * (i + 2)) % 7) * 0.1})


def plan(t):
    return H.subtype_options(plan_rows(t))


AG = "CAST(agent_id AS VARCHAR)"
SEGS = "(VALUES " + ", ".join(f"('{s}', {i}, {v['utility']}e0, {v['delay'][0]}, {v['delay'][1]}, {v['duration'][0]}, {v['duration'][1]}, {v['window'][0]}, {v['window'][1]})"
                              for i, (s, v) in enumerate(P.SEGMENTS.items())) + ") s(subtype, i, base, d0, d1, u0, u1, w0, w1)"
PERSON = " + ".join(f"CASE WHEN subtype IN ({', '.join(repr(x) for x in ss)}) THEN {w}e0 * ({d} - 0.5e0) ELSE 0e0 END" for d, w, ss in P.PERSONALITY)
INTEREST = " OR ".join(f"(primary_interest = '{k}' AND subtype IN ({', '.join(repr(x) for x in ss)}))" for k, ss in P.INTEREST_SUBTYPES.items())
WINDOWS = "CASE " + " ".join(f"WHEN time_window = '{k}' THEN CASE WHEN start / 60e0 BETWEEN {a} AND {b} THEN {x}e0 ELSE {y}e0 END" for k, (a, b, x, y) in P.TIME_WINDOW_BONUS.items()) + " ELSE 0e0 END"
PLAN = f"""{COEF}, r0 AS (SELECT b.*, s.*, 900 + (agent_id * 7) % 180 + CAST(d0 + floor({sql_u(AG, 'subtype', "'plan-delay'")} * (d1 - d0 + 1)) AS BIGINT) AS st0,
  CAST(u0 + floor({sql_u(AG, 'subtype', "'plan-duration'")} * (u1 - u0 + 1)) AS BIGINT) AS duration, ((agent_id * (i + 3)) % 41) * 0.1e0 AS d_out, ((agent_id * (i + 5)) % 37) * 0.1e0 AS d_back,
  0.7e0 + ((agent_id * (i + 2)) % 7) * 0.1e0 AS pref FROM b, {SEGS}),
 r1 AS (SELECT *, greatest(st0, w0) AS start FROM r0), r2 AS (SELECT * FROM r1 WHERE start + duration <= w1),
 pl AS (SELECT *, base + 0.35e0 * intrinsic + 0.2e0 * escape + 0.15e0 * travel_affinity + 0.25e0 * (pref - 1) + {PERSON} + CASE WHEN {INTEREST} THEN 0.12e0 ELSE 0e0 END + {WINDOWS} AS act,
  0.12e0 * (d_out + d_back) * greatest(0.65e0, least(1.45e0, 1 + 0.35e0 * (risk_aversion - 0.5e0) + 0.25e0 * (budget_sensitivity - 0.5e0) - 0.2e0 * (variety_seeking - 0.5e0) - 0.1e0 * (platform_affinity - 0.5e0)))
   * CASE WHEN subtype IN ('park', 'workout_or_run') AND walk_tolerance >= 30 THEN 0.92e0 ELSE 1e0 END AS burden FROM r2),
 op AS (SELECT *, act - burden + ({sql_u(AG, 'subtype', "'plan-noise'")} * 2 - 1) * 0.05e0 AS net FROM pl)"""


@query("subtype_options", f"WITH {PLAN} SELECT agent_id, subtype, start, duration, round(act, 9) AS activity_utility, round(net, 9) AS net_utility FROM op")
def subtype_options(t):
    return rounded(plan(t).select("agent_id", "subtype", "start", "duration", "activity_utility", "net_utility"), 9)


@query("participation", f"""WITH {PLAN}, bn AS (SELECT agent_id, max(net) AS best_net FROM op GROUP BY agent_id),
 pp AS (SELECT agent_id, best_net, greatest(0e0, least(0.95e0, 1 / (1 + exp(-(-0.45e0 + 1.05e0 * {TPB.replace('0.9e0 * 0.8e0', '0.9e0 * 0.5e0')} + 0.7e0 * (0.3e0 * intrinsic + 0.2e0 * escape + 0.18e0 * (social_orientation - 0.5e0)
  + 0.18e0 * (variety_seeking - 0.5e0) + 0.15e0 * (local_leisure_frequency - 0.5e0)) + 0.6e0 * best_net + 0.16e0 * (spontaneity_share - 0.5e0) - 0.12e0 * (negative_recommendation_experience - 0.5e0) + 0.1e0 * (city_familiarity - 0.5e0)))))) AS p
  FROM b JOIN bn USING (agent_id)) SELECT agent_id, round(p, 9) AS p_participate, {sql_u(AG, "'plan-go'")} < p AND best_net > -0.15e0 AS goes_out FROM pp""")
def participation(t):
    return rounded(H.participation(behavior_coefficients(t.agents), plan(t)).select("agent_id", "p_participate", "goes_out"), 9)


@query("subtype_choice", f"""WITH {PLAN}, tw AS (SELECT agent_id, subtype, i, net * greatest(0.35e0, 2.5e0 * (1 + 0.55e0 * (maximization - 0.5e0)) * (1 - 0.3e0 * (spontaneity_share - 0.5e0))) AS v FROM op),
 ew AS (SELECT *, exp(v - max(v) OVER (PARTITION BY agent_id)) AS w FROM tw), rw AS (SELECT *, sum(w) OVER (PARTITION BY agent_id ORDER BY i) AS run, sum(w) OVER (PARTITION BY agent_id) AS tot FROM ew),
 dr AS (SELECT agent_id, min_by(subtype, i) AS chosen_subtype FROM rw WHERE run > {sql_u(AG, "'plan-subtype'")} * tot GROUP BY agent_id)
 SELECT agent_id, subtype, round(w / tot, 9) AS p, chosen_subtype FROM rw JOIN dr USING (agent_id)""")
def subtype_choice(t):
    rows = H.subtype_choice(plan(t)).select("agent_id", "chosen_subtype", F.explode(F.arrays_zip("opts.subtype", "probs")).alias("z"))
    return rounded(rows.select("agent_id", c("z.subtype").alias("subtype"), c("z.probs").alias("p"), "chosen_subtype"), 9)


@query("acceptance_eta", """WITH n AS (SELECT trip_key, agent_id, activity_utility, coalesce(sum(CAST(accepted AS INT)) OVER (PARTITION BY treatment, seed, agent_id ORDER BY day, depart, trip_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM f_trips)
 SELECT trip_key, round(greatest(0.05e0, least(0.95e0, 0.52e0 + 0.4e0 * (trust_platforms - 0.5e0) - 0.4e0 * (autonomy_preference - 0.5e0) + 0.18e0 * (activity_utility - 0.5e0) + 0.015e0 * least(5, k))), 9) AS eta FROM n JOIN f_agents USING (agent_id)""")
def acceptance_eta(t):
    rows = memory(t).select("trip_key", "agent_id", "activity_utility", "n_accepted").join(t.agents.select("agent_id", "trust_platforms", "autonomy_preference"), "agent_id")
    return rounded(rows.select("trip_key", H.acceptance_eta(c("trust_platforms"), c("autonomy_preference"), c("activity_utility"), c("n_accepted")).alias("eta")), 9)
