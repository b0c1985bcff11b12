"""Street network."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise.operators import network as D
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import hav

c = F.col


def points(t):
    return t.users.select("user_id", "lat", "lon")


NEAR = f"nn AS (SELECT user_id, node_id, nla, nlo, d FROM (SELECT u.user_id, n.node_id, n.lat AS nla, n.lon AS nlo, {hav('round(u.lat, 6)', 'round(u.lon, 6)', 'n.lat', 'n.lon')} AS d, row_number() OVER (PARTITION BY u.user_id ORDER BY {hav('round(u.lat, 6)', 'round(u.lon, 6)', 'n.lat', 'n.lon')}, n.node_id) AS rn FROM f_users u, f_nodes n) WHERE rn = 1)"


@query("nearest_node", f"WITH {NEAR} SELECT user_id, node_id, round(d, 7) AS snap_km FROM nn")
def nearest_node(t):
    return rounded(D.nearest_node(points(t), t.nodes).select("user_id", "node_id", "snap_km"), 7)


@query("snap_points", f"WITH {NEAR} SELECT user_id, round(nla + 1.7e-8, 6) AS lat, round(nlo + 1.7e-8, 6) AS lon FROM nn")
def snap_points(t):
    return rounded(D.snap_points(points(t), t.nodes).select("user_id", (c("lat") + 1.7e-8).alias("lat"), (c("lon") + 1.7e-8).alias("lon")))


@query("min_parallel_edges", "SELECT u, v, min(length_m) AS length_m FROM (SELECT u, v, length_m FROM f_edges UNION ALL SELECT u, v, CASE WHEN u % 3 = 0 THEN 1e0 ELSE length_m + 5 END FROM f_edges) GROUP BY u, v")
def min_parallel_edges(t):
    twin = t.edges.withColumn("length_m", F.when(c("u") % 3 == 0, F.lit(None)).otherwise(c("length_m") + 5)).withColumn("k", c("k") + 10)
    return D.min_parallel_edges(t.edges.unionByName(twin))


def depots(t):
    """One source node per nation."""
    n = t.part.agg(F.count(F.lit(1))).scalar()
    return t.nation.select(((c("n_nationkey") * 397) % n).cast("long").alias("src"))


PATHS = """dep AS (SELECT DISTINCT CAST((n_nationkey * 397) % (SELECT count(*) FROM part) AS BIGINT) AS src FROM nation), ed AS (SELECT u, v, min(length_m) AS w FROM f_edges GROUP BY ALL),
 sp(src, node, d) USING KEY (src, node) AS (SELECT src, src, 0e0 FROM dep UNION SELECT n.src, n.v, n.d FROM (SELECT sp.src, ed.v, min(sp.d + ed.w) AS d FROM sp JOIN ed ON ed.u = sp.node GROUP BY ALL) n
   LEFT JOIN recurring.sp r ON r.src = n.src AND r.node = n.v WHERE n.d < coalesce(r.d, 1e18))"""


@query("shortest_paths", f"WITH RECURSIVE {PATHS} SELECT src, node, round(d, 6) AS dist_m FROM sp")
def shortest_paths(t):
    return rounded(D.shortest_paths(t.edges, depots(t)).select("src", "node", "dist_m"))


def targets(t):
    return t.places.where(c("category") == "cafe").select(c("place_id").alias("node_id"))


@query("target_pruned_paths", f"WITH RECURSIVE {PATHS} SELECT src, node, round(d, 6) AS dist_m FROM sp WHERE node IN (SELECT place_id FROM f_places WHERE category = 'cafe')")
def target_pruned_paths(t):
    return rounded(D.shortest_paths(t.edges, depots(t), targets(t)).select("src", "node", "dist_m"))


def trip_pairs(t):
    """Trips from the depot of the customer's nation; some end outside the network."""
    n = t.part.agg(F.count(F.lit(1))).scalar()
    trips = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    return trips.select("o_orderkey", ((c("c_nationkey") * 397) % n).cast("long").alias("origin"), ((c("o_orderkey") * 31) % n).cast("long").alias("dest"))


@query("route_lengths", f"""WITH RECURSIVE {PATHS}, tp AS (SELECT o_orderkey, CAST((c_nationkey * 397) % (SELECT count(*) FROM part) AS BIGINT) AS origin, (o_orderkey * 31) % (SELECT count(*) FROM part) AS dest FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderkey, round(CASE WHEN origin = dest THEN 0e0 ELSE coalesce(d / 1000, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) END, 6) AS km FROM tp LEFT JOIN sp ON sp.src = origin AND sp.node = dest
 JOIN f_nodes a ON a.node_id = origin JOIN f_nodes b ON b.node_id = dest""")
def route_lengths(t):
    return rounded(D.route_lengths(trip_pairs(t), D.shortest_paths(t.edges, depots(t)), t.nodes).select("o_orderkey", "km"))


# predecessors follow from the distances: the last edge of a shortest path closes the gap
ROUTES = f"""{PATHS}, tp AS (SELECT DISTINCT CAST((c_nationkey * 397) % (SELECT count(*) FROM part) AS BIGINT) AS origin, (o_orderkey * 31) % (SELECT count(*) FROM part) AS dest FROM orders JOIN customer ON o_custkey = c_custkey),
 pre AS (SELECT b.src, b.node, min(ed.u) AS pred FROM sp b JOIN ed ON ed.v = b.node JOIN sp a ON a.src = b.src AND a.node = ed.u WHERE b.node <> b.src AND abs(a.d + ed.w - b.d) < 1e-6 GROUP BY ALL),
 walk(origin, dest, here, back) AS (SELECT tp.origin, tp.dest, tp.dest, 0 FROM tp JOIN sp ON sp.src = origin AND sp.node = dest UNION ALL SELECT w.origin, w.dest, pre.pred, back + 1 FROM walk w JOIN pre ON pre.src = w.origin AND pre.node = w.here),
 pts AS (SELECT origin, dest, here, back FROM walk UNION ALL SELECT origin, dest, n, b FROM tp, LATERAL (VALUES (dest, 0), (origin, 1)) v(n, b) WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.src = tp.origin AND sp.node = tp.dest))"""


@query("route_geometry", f"""WITH RECURSIVE {ROUTES} SELECT origin, dest, row_number() OVER (PARTITION BY origin, dest ORDER BY back DESC) - 1 AS i, round(lat, 6) AS lat, round(lon, 6) AS lon
 FROM pts JOIN f_nodes n ON n.node_id = pts.here""")
def route_geometry(t):
    """All points of the shortest route of every pair."""
    found = D.route_geometry(trip_pairs(t), D.shortest_paths(t.edges, depots(t), near=True), t.edges, t.nodes)
    points = found.select("origin", "dest", F.posexplode("path").alias("i", "pt"))
    return points.select("origin", "dest", c("i").cast("long").alias("i"), c("pt.lat").alias("lat"), c("pt.lon").alias("lon"))


def reach(name: str, a: str, b: str) -> str:
    """Nodes that node 0 reaches over the edges, as recursive SQL."""
    return f"{name}(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.{b} FROM {name} JOIN f_edges e ON e.{a} = {name}.node)"


@query("largest_component", f"""WITH RECURSIVE {reach('fw', 'u', 'v')}, {reach('bw', 'v', 'u')}, both_ways AS (SELECT node FROM fw JOIN bw USING (node))
 SELECT node AS node_id FROM both_ways WHERE (SELECT count(*) FROM both_ways) * 2 > (SELECT count(*) FROM part)""")
def largest_component(t):
    """Largest strongly connected part of the directed graph.  The SQL takes the part of
    node 0, which is the largest as it has over half of all nodes."""
    return D.largest_component(t.edges)


@query("weak_component", """WITH RECURSIVE any_way AS (SELECT u AS a, v AS b FROM f_edges UNION ALL SELECT v, u FROM f_edges),
 r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT y.b FROM r JOIN any_way y ON y.a = r.node)
 SELECT node AS node_id FROM r WHERE (SELECT count(*) FROM r) * 2 > (SELECT count(*) FROM part)""")
def weak_component(t):
    """Largest part when the direction of the edges does not matter."""
    return D.largest_component(t.edges, strong=False)


def streets(t):
    line = F.array(F.struct(c("u_lat").alias("lat"), c("u_lon").alias("lon")), F.struct(c("v_lat").alias("lat"), c("v_lon").alias("lon")))
    return t.streets.select("u", "v", "k", "length_m", line.alias("geometry"))


def shops(t):
    """Suppliers as places off the street."""
    s = c("s_suppkey")
    return t.supplier.select(s.alias("place_id"), s.alias("pos"), (40.70 + ((s * 7919) % 9973) * 0.0000097).alias("lat"), (-74.02 + ((s * 6007) % 8999) * 0.0000098).alias("lon"))


SHOPS = "sh AS (SELECT s_suppkey AS place_id, 40.70e0 + ((s_suppkey * 7919) % 9973) * 0.0000097e0 AS lat, -74.02e0 + ((s_suppkey * 6007) % 8999) * 0.0000098e0 AS lon FROM supplier)"
SPLIT = f"""{SHOPS}, st AS MATERIALIZED (SELECT *, v_lat - u_lat AS dy, v_lon - u_lon AS dx, sqrt((v_lat - u_lat) ** 2 + (v_lon - u_lon) ** 2) AS len FROM f_streets),
 pr AS (SELECT place_id, sh.lat, sh.lon, st.*, greatest(0e0, least(1e0, ((lat - u_lat) * dy + (lon - u_lon) * dx) / (len * len))) AS f FROM sh, st),
 ds AS (SELECT *, sqrt((lat - (u_lat + dy * f)) ** 2 + (lon - (u_lon + dx * f)) ** 2) AS dist FROM pr),
 ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY round(dist, 13), least(u, v), u, v) AS rn FROM ds) WHERE rn = 1)"""


@query("nearest_edge", f"WITH {SPLIT} SELECT place_id, least(u, v) AS s0, greatest(u, v) AS s1, round(dist, 9) AS dist FROM ne")
def nearest_edge(t):
    found = D.nearest_edge(shops(t), streets(t))
    return rounded(found.select("place_id", F.least("u", "v").alias("s0"), F.greatest("u", "v").alias("s1"), "dist"), 9)


@query("split_edges", f"""WITH {SPLIT}, hit AS (SELECT place_id, least(u, v) AS s0, greatest(u, v) AS s1, u_lat + dy * f AS la, u_lon + dx * f AS lo FROM ne),
 sp AS (SELECT st.* FROM st WHERE EXISTS (SELECT 1 FROM hit WHERE s0 = least(st.u, st.v) AND s1 = greatest(st.u, st.v))),
 pt AS (SELECT u, v, length_m, len, 0e0 AS p, 0 AS r, u AS node, -1 AS o FROM sp UNION ALL SELECT u, v, length_m, len, len, 2, v, -1 FROM sp UNION ALL
  SELECT u, v, length_m, len, len * greatest(0e0, least(1e0, ((la - u_lat) * dy + (lo - u_lon) * dx) / (len * len))), 1, -(place_id + 1), place_id FROM sp JOIN hit ON s0 = least(u, v) AND s1 = greatest(u, v)),
 ch AS (SELECT *, lag(node) OVER w AS a, lag(p) OVER w AS pa FROM pt WINDOW w AS (PARTITION BY u, v ORDER BY p, r, o))
 SELECT u, v, round(length_m, 5) AS length_m FROM st WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.u = st.u AND sp.v = st.v) UNION ALL
 SELECT a, node, round(greatest(0.1e0, length_m * (p - pa) / len), 5) FROM ch WHERE a IS NOT NULL AND a <> node""")
def split_edges(t):
    _, edges = D.split_edges(shops(t), streets(t))
    return rounded(edges.select("u", "v", "length_m"), 5)


@query("network_bounds", """SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon, count(*) AS num_nodes,
 CAST(sum(CAST(is_base AS INT)) AS BIGINT) AS num_base_nodes, (SELECT count(*) FROM f_edges) AS num_edges FROM f_nodes""")
def network_bounds(t):
    df = D.network_bounds(t.nodes, t.edges)
    return df.withColumns({x: F.round(x, 6) for x in ("center_lat", "center_lon")})
