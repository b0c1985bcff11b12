"""Trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import functions as X
from tripwise.operators import trajectory as J
from tripwise.plans.registry import query, rounded
from tripwise.session import scratch_path
from tripwise.plans.scalars_queries import hav

c = F.col
BOX = (40.72, -73.99, 40.77, -73.95)
IN = "lat BETWEEN 40.72 AND 40.77 AND lon BETWEEN -73.99 AND -73.95"
OFF = 1.7e-8  # keeps short decimals off rounding ties

# one row per vertex, with the running length
VERTS = f"""v AS (SELECT * EXCLUDE (path, i), i - 1 AS i, pt.lat AS lat, pt.lon AS lon FROM (SELECT *, unnest(path) AS pt, generate_subscripts(path, 1) AS i FROM f_moves)),
 g AS (SELECT *, CASE WHEN i = 0 THEN 0e0 ELSE {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS step FROM v WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 cu AS (SELECT *, sum(step) OVER (PARTITION BY trip_key ORDER BY i) AS cum FROM g)"""


@query("cumulative_km", f"WITH {VERTS} SELECT trip_key, i, round(cum, 8) AS km FROM cu")
def cumulative_km(t):
    rows = J.with_cumulative(t.moves).select("trip_key", F.posexplode("cum").alias("i", "km"))
    return rounded(rows.withColumn("i", c("i").cast("long")), 8)


def sql_at(frac: str, source: str = "cu") -> str:
    """Point at a share of the length, from vertex rows."""
    return f"""tg AS (SELECT *, max(cum) OVER (PARTITION BY trip_key) * ({frac}) AS target, lag(cum) OVER w AS c0, lag(lat) OVER w AS la0, lag(lon) OVER w AS lo0 FROM {source} WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_key ORDER BY i) AS rn FROM tg WHERE i >= 1 AND cum >= target - 1e-12) WHERE rn = 1),
 pos_at AS (SELECT trip_key, la0 + (lat - la0) * f AS lat, lo0 + (lon - lo0) * f AS lon FROM (SELECT *, CASE WHEN cum - c0 <= 0 THEN 0e0 ELSE (target - c0) / (cum - c0) END AS f FROM ft))"""


@query("position_at_fraction", f"WITH {VERTS}, {sql_at('(trip_key % 10) * 0.1e0')} SELECT trip_key, round(lat + {OFF}, 7) AS lat, round(lon + {OFF}, 7) AS lon FROM pos_at")
def position_at_fraction(t):
    m = J.with_cumulative(t.moves)
    p = m.withColumn("p", X.position_at_fraction(c("path"), c("cum"), (c("trip_key") % 10) * 0.1))
    return rounded(p.select("trip_key", (c("p.lat") + OFF).alias("lat"), (c("p.lon") + OFF).alias("lon")), 7)


DOWN = """dn AS (SELECT trip_key, t0, t1, mode, unnest(CASE WHEN n_vertices <= 12 THEN path ELSE list_transform(range(0, 12), lambda i: path[CAST(round_even(i * (n_vertices - 1) / 11e0, 0) AS BIGINT) + 1]) END) AS pt,
  generate_subscripts(CASE WHEN n_vertices <= 12 THEN path ELSE list_transform(range(0, 12), lambda i: path[1]) END, 1) - 1 AS i FROM f_moves)"""


@query("downsample", f"WITH {DOWN} SELECT trip_key, i, round(pt.lat + {OFF}, 7) AS lat, round(pt.lon + {OFF}, 7) AS lon FROM dn")
def downsample(t):
    rows = t.moves.select("trip_key", F.posexplode(X.downsample(c("path"), 12)).alias("i", "p"))
    return rounded(rows.select("trip_key", c("i").cast("long").alias("i"), (c("p.lat") + OFF).alias("lat"), (c("p.lon") + OFF).alias("lon")), 7)


def homes(t):
    """Home of everyone with a trip on that day."""
    return t.moves.select(*J.DAY).distinct().withColumns({"lat": 40.70 + (c("agent_id") % 53) * 0.00201, "lon": -74.02 + (c("agent_id") % 47) * 0.00203})


def stays(t):
    return J.stays(t.moves.select(*J.DAY, "trip_key", "t0", "t1", "lat1", "lon1", "purpose"), homes(t))


STAYS = """hm AS (SELECT DISTINCT treatment, seed, day, agent_id, 40.70e0 + (agent_id % 53) * 0.00201e0 AS hla, -74.02e0 + (agent_id % 47) * 0.00203e0 AS hlo FROM f_paths),
 lg AS (SELECT *, lag(t1, 1, 0) OVER w AS p1, lag(lat1) OVER w AS pla, lag(lon1) OVER w AS plo, lag(purpose) OVER w AS pst, lead(t0) OVER w AS nx FROM f_paths WINDOW w AS (PARTITION BY treatment, seed, day, agent_id ORDER BY t0, trip_key)),
 sy AS (SELECT treatment, seed, day, agent_id, p1 AS t0, t0 AS t1, coalesce(pla, hla) AS lat, coalesce(plo, hlo) AS lon, coalesce(pst, 'home') AS state FROM lg JOIN hm USING (treatment, seed, day, agent_id) WHERE t0 > p1
  UNION ALL SELECT treatment, seed, day, agent_id, t1, 1440, lat1, lon1, purpose FROM lg WHERE nx IS NULL)"""


@query("stays", f"WITH {STAYS} SELECT treatment, seed, day, agent_id, t0, t1, round(lat + {OFF}, 7) AS lat, round(lon + {OFF}, 7) AS lon, state FROM sy")
def stays_query(t):
    return rounded(stays(t).withColumns({"lat": c("lat") + OFF, "lon": c("lon") + OFF}), 7)


@query("moves", f"WITH {VERTS} SELECT trip_key, mode, purpose, count(*) AS n_points, round(max(cum), 8) AS km FROM cu GROUP BY ALL")
def moves(t):
    """Each distinct origin-destination pair is routed once and joined back."""
    key = ["lat0", "lon0", "lat1", "lon1", "n_vertices"]
    ids = {"origin": F.struct("lat0", "lon0"), "dest": F.struct("lat1", "lon1", "n_vertices")}
    routes = t.moves.select(*key, "path").withColumns(ids).groupBy("origin", "dest").agg(F.first("path").alias("path"))
    trips = t.moves.drop("path").withColumns(ids)
    m = J.moves_from_trips(trips, routes)
    return rounded(m.select("trip_key", "mode", "purpose", F.size("path").cast("long").alias("n_points"), F.element_at("cum", -1).alias("km")), 8)


MERGED = """mg AS (SELECT *, t0 + day * 1440 AS a0, t1 + day * 1440 AS a1, CAST(agent_id AS VARCHAR) || '-' || CAST(day AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY treatment, seed, day, agent_id ORDER BY t0, trip_key) - 1 AS VARCHAR) AS trip_id FROM f_moves)"""


@query("merge_days", f"WITH {MERGED} SELECT trip_key, trip_id, a0 AS t0, a1 AS t1 FROM mg")
def merge_days(t):
    return J.merge_days(t.moves).select("trip_key", "trip_id", "t0", "t1")


@query("trip_lookup", f"WITH {MERGED} SELECT trip_key, trip_id, mode FROM mg WHERE trip_id = '7-0-0'")
def trip_lookup(t):
    return J.trip_lookup(J.merge_days(t.moves), "7-0-0").select("trip_key", "trip_id", "mode")


@query("time_span", f"WITH {STAYS} SELECT max(e) AS time_span FROM (SELECT t1 + day * 1440 AS e FROM f_paths UNION ALL SELECT t1 + day * 1440 FROM sy)")
def time_span(t):
    return J.time_span(J.merge_days(t.moves), J.merge_day_stays(stays(t)))


ALLV = """dn AS (SELECT trip_key, t0, t1, mode, unnest(path) AS pt, unnest(range(0, len(path))) AS i FROM f_moves)"""
KEYF = f"""{ALLV}, ds AS (SELECT *, CASE WHEN i = 0 THEN 0e0 ELSE {hav('lag(pt.lat) OVER w', 'lag(pt.lon) OVER w', 'pt.lat', 'pt.lon')} END AS step FROM dn WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 dc AS (SELECT *, sum(step) OVER (PARTITION BY trip_key ORDER BY i) AS cum, sum(step) OVER (PARTITION BY trip_key) AS tot FROM ds)"""


RGB = "CASE mode WHEN 'car' THEN '230,80,60' WHEN 'walk' THEN '80,170,90' WHEN 'bike' THEN '240,180,40' ELSE '70,130,220' END"
STATE_RGB = "CASE state WHEN 'home' THEN '80,170,90' WHEN 'work' THEN '240,150,40' WHEN 'leisure' THEN '160,90,210' ELSE '230,80,60' END"


def off_ties(t):
    """Moves whose points and times lie off rounding ties."""
    shifted = F.transform("path", lambda p: F.struct((p["lat"] + OFF).alias("lat"), (p["lon"] + OFF).alias("lon")))
    return t.moves.withColumns({"path": shifted, "t0": c("t0") + 0.0137, "t1": c("t1") + 0.0141})


def record_rows(rows):
    """One row per vertex of a record."""
    z = F.posexplode(F.arrays_zip("points", "timestamps")).alias("i", "z")
    return rows.select("trip_key", F.array_join("color", ",").alias("color"), z).select(
        "trip_key", c("i").cast("long").alias("i"), c("z.points.lat").alias("lat"), c("z.points.lon").alias("lon"), c("z.timestamps").alias("at"), "color")


STAMP = "round_even(t0 + 0.0137e0 + (t1 + 0.0141e0 - t0 - 0.0137e0) * (cum / CASE WHEN tot = 0 THEN 1e0 ELSE tot END), 1)"


@query("trip_keyframes", f"WITH {KEYF} SELECT trip_key, i, round_even(pt.lat + {OFF}, 5) AS lat, round_even(pt.lon + {OFF}, 5) AS lon, {STAMP} AS at, {RGB} AS color FROM dc")
def trip_keyframes(t):
    return record_rows(J.trip_keyframes(off_ties(t)))


@query("trip_geometry", f"WITH {VERTS}, tt AS (SELECT *, max(cum) OVER (PARTITION BY trip_key) AS tot FROM cu) SELECT trip_key, i, round_even(lat + {OFF}, 6) AS lat, round_even(lon + {OFF}, 6) AS lon, {STAMP} AS at, {RGB} AS color FROM tt")
def trip_geometry(t):
    return record_rows(J.trip_geometry(off_ties(t)))


WINDOWS = [(480, 540), (1400, 2000), (3000, 3600)]
WIN = "(VALUES (0, 480, 540), (1, 1400, 2000), (2, 3000, 3600)) w(win, lo, hi)"
BOXED = "NOT (greatest(lat0, lat1) < 40.72 OR least(lat0, lat1) > 40.77 OR greatest(lon0, lon1) < -73.99 OR least(lon0, lon1) > -73.95)"


@query("window_trips", f"WITH {MERGED} SELECT trip_key, win AS \"window\" FROM mg, {WIN} WHERE a1 >= lo AND a0 <= hi AND {BOXED}")
def window_trips(t):
    """Over moves stored with their extent, as a viewer would keep them."""
    path = scratch_path(t.spark, "moves")
    J.with_extent(J.merge_days(t.moves)).write.parquet(path)
    return J.window_trips(t.spark.read.parquet(path), WINDOWS, BOX).select("trip_key", "window")


@query("window_stays", f"""WITH {STAYS} SELECT treatment, seed, agent_id, t0 + day * 1440 AS t0, t1 + day * 1440 AS t1, win AS "window", state, {STATE_RGB} AS color FROM sy, {WIN}
 WHERE t1 + day * 1440 >= lo AND t0 + day * 1440 <= hi AND {IN}""")
def window_stays(t):
    rows = J.window_stays(J.merge_day_stays(stays(t)), WINDOWS, BOX)
    return rows.select("treatment", "seed", "agent_id", "t0", "t1", "window", "state", F.array_join("color", ",").alias("color"))


INSTANTS = [500.5, 800.0, 2161.25, 3900.0]
TS = "(VALUES (500.5e0), (800e0), (2161.25e0), (3900e0)) q(t)"
def at_moves(ts: str) -> str:
    return f"""{MERGED}, hit AS (SELECT * FROM (SELECT treatment, seed, agent_id, t, trip_key, mode, (t - a0) / greatest(1, a1 - a0) AS frac, row_number() OVER (PARTITION BY treatment, seed, agent_id, t ORDER BY a0, trip_key) AS rn
  FROM mg, {ts} WHERE t BETWEEN a0 AND a1) WHERE rn = 1)"""


def positions_sql(ts: str) -> str:
    return f"""WITH {at_moves(ts)}, {STAYS}, {VERTS}, sgm AS (SELECT trip_key, i, cum, max(cum) OVER (PARTITION BY trip_key) AS tot, lag(cum) OVER w AS c0, lag(lat) OVER w AS la0, lag(lon) OVER w AS lo0, lat AS la1, lon AS lo1
   FROM cu WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 mv AS (SELECT * FROM (SELECT h.*, CASE WHEN cum - c0 <= 0 THEN 0e0 ELSE (h.frac * tot - c0) / (cum - c0) END AS f, la0, la1, lo0, lo1, row_number() OVER (PARTITION BY treatment, seed, agent_id, t ORDER BY i) AS rk
   FROM hit h JOIN sgm USING (trip_key) WHERE i >= 1 AND cum >= h.frac * tot) WHERE rk = 1),
 st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY treatment, seed, agent_id, t ORDER BY t0 + day * 1440, t1 + day * 1440) AS rn
   FROM sy, {ts} WHERE t BETWEEN t0 + day * 1440 AND t1 + day * 1440) WHERE rn = 1)
 SELECT treatment, seed, agent_id, t, round(la0 + (la1 - la0) * f, 7) AS lat, round(lo0 + (lo1 - lo0) * f, 7) AS lon, 'in_transit' AS state, mode FROM mv UNION ALL
 SELECT treatment, seed, agent_id, t, round(lat + {OFF}, 7), round(lon + {OFF}, 7), state, '' FROM st WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.treatment = st.treatment AND h.seed = st.seed AND h.agent_id = st.agent_id AND h.t = st.t)"""


def placed(t, instants):
    rows = J.positions_at(J.merge_days(t.moves), J.merge_day_stays(stays(t)), instants)
    shift = F.when(c("state") == "in_transit", 0.0).otherwise(OFF)
    return rounded(rows.select("treatment", "seed", "agent_id", "t", (c("lat") + shift).alias("lat"), (c("lon") + shift).alias("lon"), "state", "mode"), 7)


@query("positions_at", positions_sql(TS))
def positions_at(t):
    return placed(t, INSTANTS)


@query("positions_at_table", positions_sql("(SELECT DISTINCT (p_size * 83 + 7) + 0.25e0 AS t FROM part) q"))
def positions_at_table(t):
    """Instants from a table."""
    return placed(t, t.part.select((c("p_size") * 83 + 7 + F.lit(0.25)).alias("t")))


KEYPOS = f"""kv AS (SELECT trip_key, t0 + day * 1440 AS t0, t1 + day * 1440 AS t1, unnest(path) AS pt, unnest(range(0, len(path))) AS i FROM f_moves),
 ks AS (SELECT *, CASE WHEN i = 0 THEN 0e0 ELSE {hav('lag(pt.lat) OVER w', 'lag(pt.lon) OVER w', 'pt.lat', 'pt.lon')} END AS step FROM kv WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 kc AS (SELECT *, sum(step) OVER (PARTITION BY trip_key ORDER BY i) AS cum, sum(step) OVER (PARTITION BY trip_key) AS tot FROM ks),
 kr AS (SELECT trip_key, i, round_even(pt.lat + {OFF}, 5) AS lat, round_even(pt.lon + {OFF}, 5) AS lon, {STAMP} AS stamp FROM kc),
 kp AS (SELECT *, lag(lat) OVER w AS la0, lag(lon) OVER w AS lo0, lag(stamp) OVER w AS at0, max(stamp) OVER (PARTITION BY trip_key) AS at1 FROM kr WINDOW w AS (PARTITION BY trip_key ORDER BY i)),
 kh AS (SELECT kp.*, t, row_number() OVER (PARTITION BY trip_key, t ORDER BY i) AS rn FROM kp, {TS} WHERE t <= stamp AND t <= at1 AND (i > 0 OR t = stamp))"""


@query("keyframe_position", f"""WITH {KEYPOS} SELECT trip_key, t, round(CASE WHEN i = 0 THEN lat ELSE la0 + (lat - la0) * (t - at0) / CASE WHEN stamp = at0 THEN 1e0 ELSE stamp - at0 END END, 7) AS lat,
 round(CASE WHEN i = 0 THEN lon ELSE lo0 + (lon - lo0) * (t - at0) / CASE WHEN stamp = at0 THEN 1e0 ELSE stamp - at0 END END, 7) AS lon FROM kh WHERE rn = 1 AND (i = 0 OR t >= at0)""")
def keyframe_position(t):
    """Along rounded records."""
    rows = J.keyframe_positions(J.trip_keyframes(J.merge_days(off_ties(t))), INSTANTS)
    return rounded(rows.select("trip_key", "t", c("position.lat").alias("lat"), c("position.lon").alias("lon")), 7)


@query("pois_in_bbox", f"SELECT place_id FROM f_places WHERE {IN}")
def pois_in_bbox(t):
    return J.pois_in_bbox(t.places, BOX).select("place_id")


@query("group_by_agent", "SELECT treatment, seed, agent_id, day, count(*) AS n, string_agg(trip_key, ',' ORDER BY t0, trip_key) AS trips FROM f_paths GROUP BY ALL")
def group_by_agent(t):
    rows = J.group_by_agent(t.moves.select("treatment", "seed", "agent_id", "day", "t0", "t1", "trip_key"))
    return rows.select("treatment", "seed", "agent_id", "day", F.size("trips").cast("long").alias("n"), F.array_join(F.transform("trips", lambda x: x["trip_key"].cast("string")), ",").alias("trips"))


@query("poi_labels", f"SELECT place_id, round_even(lon + {OFF}, 6) AS lon, round_even(lat + {OFF}, 6) AS lat, category, name || ' · ' || category AS label FROM f_places")
def poi_labels(t):
    return J.poi_labels(t.places.withColumns({"lat": c("lat") + OFF, "lon": c("lon") + OFF})).drop("pos")
