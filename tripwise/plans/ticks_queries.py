"""Per-tick series and day summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import ticks as T
from tripwise.plans.registry import query, rounded

ROAD, TRANSIT = 60.0, 120.0
DEP = """d AS (SELECT treatment, seed, day, depart // 5 * 5 AS tick, count(*) AS departures, CAST(sum(CASE WHEN mode = 'car' THEN 1 ELSE 0 END) AS BIGINT) AS road_volume,
 CAST(sum(CASE WHEN mode = 'transit' THEN 1 ELSE 0 END) AS BIGINT) AS transit_volume, avg(travel_min) AS tt, avg(cost) AS cc, avg(emissions_g) AS ee FROM f_trips GROUP BY ALL)"""


@query("tick_series", f"""WITH {DEP}, g AS (SELECT treatment, seed, day, range AS tick FROM (SELECT DISTINCT treatment, seed, day FROM f_trips), range(0, 1440, 5)),
 e AS (SELECT treatment, seed, day, tick, sum(x) AS delta FROM (SELECT treatment, seed, day, depart // 5 * 5 AS tick, 1 AS x FROM f_trips UNION ALL
   SELECT treatment, seed, day, CAST(ceil(arrival / 5e0) * 5 AS BIGINT), -1 FROM f_trips) GROUP BY ALL)
 SELECT treatment, seed, day, tick, coalesce(departures, 0) AS departures, coalesce(road_volume, 0) AS road_volume, coalesce(transit_volume, 0) AS transit_volume,
  round(coalesce(tt, 0e0), 6) AS avg_travel_time_min, round(coalesce(cc, 0e0), 6) AS avg_cost, round(coalesce(ee, 0e0), 6) AS avg_emissions_g,
  CAST(sum(coalesce(delta, 0)) OVER (PARTITION BY treatment, seed, day ORDER BY tick) AS BIGINT) AS in_transit,
  round(1 + 0.15e0 * (coalesce(road_volume, 0) / 60e0) ** 4, 9) AS road_factor, round(1 + 0.25e0 * (coalesce(transit_volume, 0) / 120e0) ** 2, 9) AS crowd_factor
 FROM g LEFT JOIN d USING (treatment, seed, day, tick) LEFT JOIN e USING (treatment, seed, day, tick)""")
def tick_series(t):
    s = T.tick_series(t.trips, ROAD, TRANSIT)
    s = s.withColumns({c: F.round(c, 9) for c in ("road_factor", "crowd_factor")})
    return rounded(s, skip=("road_factor", "crowd_factor"))


@query("tick_mode_counts", """SELECT treatment, seed, day, depart // 5 * 5 AS tick, count(*) FILTER (mode = 'walk') AS walk, count(*) FILTER (mode = 'bike') AS bike,
 count(*) FILTER (mode = 'transit') AS transit, count(*) FILTER (mode = 'car') AS car,
 count(*) FILTER (mode IS NULL OR mode NOT IN ('walk', 'bike', 'transit', 'car')) AS other FROM f_trips GROUP BY ALL""")
def tick_mode_counts(t):
    return T.tick_mode_counts(t.trips)


@query("lagged_congestion", f"""WITH {DEP}, p AS (SELECT *, lag(road_volume, 1, 0) OVER w AS road_before, lag(transit_volume, 1, 0) OVER w AS transit_before FROM d
 WINDOW w AS (PARTITION BY treatment, seed, day ORDER BY tick))
 SELECT trip_key, road_before, transit_before, round(1 + 0.15e0 * (road_before / 60e0) ** 4, 9) AS road_factor, round(1 + 0.25e0 * (transit_before / 120e0) ** 2, 9) AS crowd_factor
 FROM f_trips t JOIN p ON t.treatment = p.treatment AND t.seed = p.seed AND t.day = p.day AND t.depart // 5 * 5 = p.tick""")
def lagged_congestion(t):
    rows = T.lagged_congestion(t.trips, ROAD, TRANSIT)
    return rounded(rows.select("trip_key", "road_before", "transit_before", "road_factor", "crowd_factor"), 9)


@query("peer_status", """WITH m AS (SELECT treatment, seed, day, depart // 5 * 5 AS tick,
 avg(CASE mode WHEN 'walk' THEN 0.2e0 WHEN 'bike' THEN 0.3e0 WHEN 'transit' THEN 0.4e0 ELSE 0.9e0 END) AS s FROM f_trips GROUP BY ALL)
 SELECT treatment, seed, day, tick, round(coalesce(lag(s) OVER (PARTITION BY treatment, seed, day ORDER BY tick), 0.5e0), 6) AS peer_status FROM m""")
def peer_status(t):
    return rounded(T.peer_status(t.trips))


def planned(t):
    return T.arrival_delay(t.trips.withColumn("planned_start", F.col("depart") + 20))


DELAY = """x AS (SELECT *, CAST(ceil(arrival / 5e0) * 5 AS BIGINT) AS handled FROM f_trips), y AS (SELECT treatment, seed, day, trip_key, handled,
 greatest(0, handled - (depart + 20)) AS delay FROM x WHERE handled < 1440)"""


@query("arrival_delay", f"WITH {DELAY} SELECT trip_key, handled, delay FROM y")
def arrival_delay(t):
    return planned(t).select("trip_key", "handled", "delay")


@query("delay_totals", f"""WITH {DELAY} SELECT treatment, seed, day, CAST(sum(CASE WHEN delay > 0 THEN 1 ELSE 0 END) AS BIGINT) AS late_arrivals,
 CAST(sum(delay) AS BIGINT) AS total_delay FROM y GROUP BY ALL""")
def delay_totals(t):
    return T.delay_totals(planned(t))


SUMMARY = f"""{DELAY}, l AS (SELECT treatment, seed, day, sum(CASE WHEN delay > 0 THEN 1 ELSE 0 END) AS late, sum(delay) AS total FROM y GROUP BY ALL),
 ag AS (SELECT treatment, seed, count(DISTINCT agent_id) AS n FROM f_trips GROUP BY ALL),
 s AS (SELECT treatment, seed, day, count(*) AS trips, avg(travel_min) AS tt, avg(cost) AS cc, avg(emissions_g) AS ee,
  {', '.join(f"count(*) FILTER (mode = '{m}') / count(*) AS mode_{m}" for m in P.MODES)},
  {', '.join(f"count(*) FILTER (purpose = '{m}') / count(*) AS purpose_{m}" for m in ('home', 'work', 'leisure'))},
  {', '.join(f"count(*) FILTER (subtype = '{m}') AS n_{m}" for m in P.SUBTYPES)},
  count(*) FILTER (purpose = 'leisure' AND source = 'organic') AS n_organic,
  count(*) FILTER (purpose = 'leisure' AND accepted) / greatest(1, count(*) FILTER (purpose = 'leisure')) AS ar,
  coalesce(avg(eta) FILTER (purpose = 'leisure'), 0e0) AS eta, coalesce(avg(liked) FILTER (purpose = 'leisure' AND liked >= 0), 0e0) AS lr,
  sum(utility) AS tu, avg(utility) AS au, sum(travel_utility) AS ttu, sum(activity_utility) AS tau FROM f_trips GROUP BY ALL)"""


@query("day_summary", f"""WITH {SUMMARY} SELECT treatment, seed, s.day + 1 AS day, trips, round(tt, 6) AS avg_travel_time_min, round(cc, 6) AS avg_cost,
 round(ee, 6) AS avg_emissions_g, {', '.join(f"round(mode_{m}, 6) AS mode_{m}" for m in P.MODES)},
 {', '.join(f"round(purpose_{m}, 6) AS purpose_{m}" for m in ('home', 'work', 'leisure'))}, {', '.join(f'n_{m}' for m in P.SUBTYPES)}, n_organic,
 round(ar, 6) AS acceptance_rate, round(eta, 6) AS avg_eta, round(lr, 6) AS like_rate, round(tu, 6) AS total_trip_utility, round(au, 6) AS avg_trip_utility,
 round(ttu, 6) AS total_travel_utility, round(tau, 6) AS total_activity_utility, CAST(coalesce(late, 0) AS BIGINT) AS late_arrivals,
 round(coalesce(total, 0) / ag.n, 6) AS avg_delay_min FROM s LEFT JOIN l USING (treatment, seed, day) LEFT JOIN ag USING (treatment, seed)""")
def day_summary(t):
    agents = t.trips.select("treatment", "seed", "agent_id").distinct()
    return rounded(T.day_summary(t.trips, planned(t), agents))


LABELS = " UNION ALL ".join(
    f"SELECT treatment, seed, day, '{d}' AS dimension, {d} AS label FROM f_trips{' WHERE subtype <> ' + chr(39) * 2 + ' AND purpose = ' + chr(39) + 'leisure' + chr(39) if d in ('subtype', 'source') else ''}"
    for d in ("mode", "purpose", "subtype", "source"))


@query("summaries_by_day", f"""SELECT treatment, seed, day + 1 AS day, dimension, label, count(*) AS n,
 round(count(*) / sum(count(*)) OVER (PARTITION BY treatment, seed, day, dimension), 6) AS share FROM ({LABELS}) GROUP BY treatment, seed, day, dimension, label""")
def summaries_by_day(t):
    """Counts and shares of all modes, purposes, subtypes and sources of every day."""
    return rounded(T.label_counts(t.trips))


@query("trip_totals", """SELECT treatment, seed, day, mode, count(*) AS trips, CAST(sum(travel_min) AS BIGINT) AS travel_time, round(sum(cost), 6) AS cost,
 round(sum(emissions_g), 6) AS emissions FROM f_trips GROUP BY ROLLUP (treatment, seed, day, mode)""")
def trip_totals(t):
    return rounded(T.trip_totals(t.trips))
