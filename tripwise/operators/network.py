"""Street-network tables: snapping, shortest paths, components, edge splits.

Nodes: node_id, lat, lon, is_base.  Edges: u, v, k, length_m, and optionally
geometry (array of lat/lon structs).  Loops over joins cut their lineage with
checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.functions import haversine_km, let
from tripwise.functions.polyline import running_sums
from tripwise.operators.boxtree import SENT_ROWS, best_k, build_tree, plane_bounds
from tripwise.operators.ordering import previous
from tripwise.operators.overlay import build_overlay, search
from tripwise.session import cut, kept

#: Single steps of routes before doubling begins, at most.
SINGLE = 24


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest node of every point by great-circle distance; equal distances go to
    the smaller id.  Points that agree to six digits are looked up once."""
    keyed = points.withColumns({"_la": F.round("lat", 6), "_lo": F.round("lon", 6)})
    asks = keyed.groupBy("_la", "_lo").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")).select(
        F.concat_ws(",", F.col("_la").cast("string"), F.col("_lo").cast("string")).alias("rid"), "_la", "_lo",
        F.col("_la").alias("lat"), F.col("_lo").alias("lon"), F.lit(0).alias("root"), F.lit(1).alias("k"))
    spots = nodes.groupBy("lat", "lon").agg(F.min("node_id").alias("pos"))
    items = spots.select(
        F.lit(0).alias("root"), "pos", F.col("lat").alias("south"), F.col("lon").alias("west"), F.col("lat").alias("north"), F.col("lon").alias("east"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("i_south"), F.col("i_west"))
    # written out, so the constant root stays a join key
    found = best_k(kept(asks), build_tree(items), lambda s, dist: -dist, -d)
    hits = found.select("_la", "_lo", F.col("i_pos").alias("node_id"), (-F.col("score")).alias("snap_km"))
    return keyed.join(hits, ["_la", "_lo"]).drop("_la", "_lo")


def snap_points(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points moved to the coordinates of their nearest node."""
    where = nodes.select("node_id", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    snapped = nearest_node(points, nodes).join(where, "node_id")
    return snapped.withColumns({"lat": F.col("_la"), "lon": F.col("_lo")}).drop("_la", "_lo")


def min_parallel_edges(edges: DataFrame) -> DataFrame:
    """Shortest of the parallel edges per direction; a missing length counts as 1."""
    return edges.groupBy("u", "v").agg(F.min(F.coalesce("length_m", F.lit(1.0))).alias("length_m"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, near: bool = False) -> DataFrame:
    """Directed shortest-path length from every source (src) to every node it reaches, or to
    the targets (node_id) only: src, node, dist_m, pred; if asked also near, the smallest node
    that a shortest path can come from.

    Searched through nested cells (``overlay``), whose number of steps doesn't follow the
    number of hops.  For many searches on one network build the overlay once and call
    ``overlay.search``.
    """
    found = search(build_overlay(edges), sources, targets, near)
    return found if not near or "near" in found.columns else _with_near(found, edges)


def target_pruned_paths(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Only the paths that end at registered targets (node_id); a search that is given the
    targets doesn't look for the others in the first place."""
    return paths.join(targets.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")


def route_lengths(pairs: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length in km of (origin, dest) node pairs: 0 for the same node, the straight
    line where there is no path."""
    def at(role: str) -> DataFrame:
        return nodes.select(F.col("node_id").alias(role), F.col("lat").alias(f"_{role}_lat"), F.col("lon").alias(f"_{role}_lon"))

    reach = paths.select(F.col("src").alias("origin"), F.col("node").alias("dest"), "dist_m")
    rows = pairs.join(reach, ["origin", "dest"], "left").join(at("origin"), "origin", "left").join(at("dest"), "dest", "left")
    straight = haversine_km(*[F.col(c) for c in ("_origin_lat", "_origin_lon", "_dest_lat", "_dest_lon")])
    km = F.when(F.col("origin") == F.col("dest"), F.lit(0.0)).otherwise(F.coalesce(F.col("dist_m") / 1000.0, straight))
    return rows.withColumn("km", km).select(*pairs.columns, "km")


def _drop_repeats(path: Column) -> Column:
    return let(path, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))


def _with_near(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths with ``near``, the smallest node that a shortest path can come from, whatever the
    search met first; null at a source and after steps of no length only."""
    hop = edges.groupBy("u", "v").agg(F.min(F.coalesce("length_m", F.lit(1.0))).alias("_w"))
    start = paths.select("src", F.col("node").alias("u"), F.col("dist_m").alias("_du"))
    end = paths.where(F.col("node") != F.col("src")).select("src", F.col("node").alias("v"), F.col("dist_m").alias("_dv"))
    tight = end.join(hop, "v").join(start, ["src", "u"]).where(
        (F.col("_du") < F.col("_dv")) & (F.abs(F.col("_du") + F.col("_w") - F.col("_dv")) < 1e-6))
    return paths.join(tight.groupBy("src", F.col("v").alias("node")).agg(F.min("u").alias("near")), ["src", "node"], "left")


def _steps_back(pairs: DataFrame, back: DataFrame) -> DataFrame:
    """(origin, dest, seq, at): all nodes of the routes, counted from the destination, over the
    predecessors ``back`` (origin, at, pred, dist_m).  A destination without one is a step from its origin.

    Steps are single until a route is as near to its origin as the nearest rows, about as many as
    routes; there pointer doubling goes on, over those rows alone.  Where the way there is
    long, doubling begins with all predecessors.
    """
    parts = int(back.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = back.select(F.col("origin").alias("_o"), F.col("at").alias("_a"), F.col("pred").alias("_to"), "dist_m").repartition(
        parts, "_o", "_a").sortWithinPartitions("_o", "_a").persist()
    on = (F.col("origin") == F.col("_o")) & (F.col("at") == F.col("_a"))
    wanted = pairs.select("origin", "dest", F.col("dest").alias("at"))
    ends = kept(wanted.join(dealt, on, "left").select("origin", "dest", "at", F.lit(0).alias("seq"), "_to", "dist_m"))
    lost = ends.where((F.col("origin") != F.col("dest")) & F.col("_to").isNull())
    done = [ends.select("origin", "dest", "at", "seq"), lost.select("origin", "dest", F.col("origin").alias("at"), F.lit(1).alias("seq"))]
    live, near, steps = ends.where(F.col("_to").isNotNull()), [], 0
    routes, size = live.count(), dealt.count()
    share = max(routes, SENT_ROWS) / max(size, 1)
    limit = dealt.agg(F.percentile_approx("dist_m", share)).first()[0] if share < 1 else float("inf")
    far = F.col("dist_m") > F.lit(limit)
    while share < 1 and steps < SINGLE and (routes := live.where(far).count()):
        steps += 1
        near.append(live.where(~far))
        moved = live.where(far).select("origin", "dest", F.col("_to").alias("at"), (F.col("seq") + 1).alias("seq"))
        step = kept(_by_rows(moved, routes).join(dealt, on, "left").select("origin", "dest", "at", "seq", "_to", "dist_m"))
        done.append(step.select("origin", "dest", "at", "seq"))
        live = step.where(F.col("_to").isNotNull())
    jump = dealt.select("_o", "_a", "_to") if routes else kept(dealt.where(~far).select("_o", "_a", "_to"))
    rows = live.select("origin", "dest", "at", "seq")
    for part in near:
        rows = rows.unionByName(part.select("origin", "dest", "at", "seq"))
    span = 1
    while True:
        more = kept(rows.join(_by_rows(jump, size), on).select("origin", "dest", F.col("_to").alias("at"), (F.col("seq") + span).alias("seq")))
        if more.isEmpty():
            break
        done.append(more)
        rows = rows.unionByName(more)
        ahead = jump.select(F.col("_o").alias("_o2"), F.col("_a").alias("_a2"), F.col("_to").alias("_to2"))
        jump = kept(jump.join(_by_rows(ahead, size), (F.col("_o") == F.col("_o2")) & (F.col("_to") == F.col("_a2"))).select("_o", "_a", F.col("_to2").alias("_to")))
        span *= 2
    dealt.unpersist()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def route_geometry(pairs: DataFrame, paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Polyline of the shortest path of each distinct (origin, dest) pair of nodes.

    The path is walked back from the destination, in the end by pointer doubling: round k knows
    where 2^k steps lead from every node, and appends as many steps as a route already has; so
    a route of 1,000 hops takes about 11 rounds.  The same node gives one point, no path a
    straight line.  Of equally long paths the smallest predecessor (``near``) counts; it is
    worked out here unless ``paths`` has it.
    """
    spot = _by_rows(nodes.select("node_id", F.struct(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).alias("pt")), nodes.count())
    known = lambda c: spot.select(F.col("node_id").alias(c))
    wanted = pairs.select("origin", "dest").distinct().join(known("dest"), "dest", "left_semi").join(known("origin"), "origin", "left_semi").select("origin", "dest")
    if "near" not in paths.columns:
        paths = _with_near(paths, edges)
    # steps of no length keep the predecessor of the search
    back = paths.where(F.col("pred").isNotNull()).select(F.col("src").alias("origin"), F.col("node").alias("at"), F.coalesce("near", "pred").alias("pred"), "dist_m")
    stops = _steps_back(wanted, back)
    if streets := "geometry" in edges.columns:
        lines = _street_lines(stops, edges, spot)
    else:
        lines = stops.join(spot.withColumnsRenamed({"node_id": "at", "pt": "line"}), "at")
    # dealt by route before they are gathered, as rows of a route hardly ever meet before
    lines = lines.select("origin", "dest", F.struct((-F.col("seq")).alias("s"), "line").alias("x")).repartition("origin", "dest")
    found = lines.groupBy("origin", "dest").agg(F.sort_array(F.collect_list("x")).alias("_p"))
    return found.select("origin", "dest", _drop_repeats(F.flatten("_p.line") if streets else F.col("_p.line")).alias("path"))


def _street_lines(stops: DataFrame, edges: DataFrame, spot: DataFrame) -> DataFrame:
    """Lines of the streets between the stops (origin, dest, seq, at) of routes; straight where there is none."""
    short = edges.groupBy("u", "v").agg(F.min_by("geometry", F.struct(F.coalesce("length_m", F.lit(1.0)), "k")).alias("_g"))
    before = F.lead("at").over(Window.partitionBy("origin", "dest").orderBy("seq"))
    hops = stops.select("origin", "dest", "seq", F.col("at").alias("v"), before.alias("u")).where("u is not null or seq = 0")
    a, b = spot.withColumnsRenamed({"node_id": "u", "pt": "_a"}), spot.withColumnsRenamed({"node_id": "v", "pt": "_b"})
    rounded = F.transform("_g", lambda p: F.struct(F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon")))
    straight = F.when(F.col("_a").isNull(), F.array("_b")).otherwise(F.array("_a", "_b"))
    return hops.join(short, ["u", "v"], "left").join(a, "u", "left").join(b, "v").select("origin", "dest", "seq", F.coalesce(rounded, straight).alias("line"))


# ------------------------------------------------------------------- components
def weak_components(edges: DataFrame) -> DataFrame:
    """Component id (smallest node) per node, by alternating large-star and small-star
    steps; the number of rounds grows with the log of the size, not the diameter."""
    pairs = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    moved = True
    while moved:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).where("a <> b").distinct()
        small = cut(small)
        moved = not small.join(pairs, ["a", "b"], "left_anti").isEmpty() or not pairs.join(small, ["a", "b"], "left_anti").isEmpty()
        pairs = small
    nodes = edges.select(F.col("u").alias("node_id")).unionByName(edges.select(F.col("v").alias("node_id"))).distinct()
    root = pairs.select(F.col("a").alias("node_id"), F.col("b").alias("component"))
    return nodes.join(root, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def _by_rows(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join: small ones as Spark likes, others joined by sorting, as their files are far
    smaller than what the driver would hold of them."""
    return side if rows <= SENT_ROWS else side.hint("merge")


def _contract(live: DataFrame, left: DataFrame, splices: list[DataFrame], singles: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Take out what needs no search, in a number of rounds that follows the log of the size.

    A node without edges in or without edges out is a component of its own.  A node v with one
    edge in and one out, u -> v -> w, gives way to an edge u -> w: it belongs to u's component if
    that is w's too, else it is alone.  Of neighbouring such nodes a coin of the round picks some,
    so chains and circles of any length shrink by a share in every round.
    """
    rounds = 0
    while True:
        rounds += 1
        size = left.count()
        into = live.groupBy(F.col("v").alias("node_id")).agg(F.count(F.lit(1)).alias("ins"), F.min("u").alias("pu"))
        out = live.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("outs"), F.min("v").alias("nw"))
        degrees = kept(left.join(_by_rows(into, size), "node_id", "left").join(_by_rows(out, size), "node_id", "left"))
        ends = degrees.where("ins is null or outs is null").select("node_id")
        coin = F.pmod(F.xxhash64(F.lit(rounds), "node_id"), F.lit(2)) == 1
        picked = degrees.where((F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("pu") != F.col("node_id")) & coin)
        before = _by_rows(picked.select(F.col("node_id").alias("pu")), size)
        spliced = picked.join(before, "pu", "left_anti").select("node_id", F.col("pu").alias("u"), F.col("nw").alias("w"))
        spliced = kept(spliced)
        gone = kept(ends.unionByName(spliced.select("node_id")))
        n = gone.count()
        if not n:
            return live, left
        singles.append(ends)
        splices.append(spliced)
        stay = live.join(_by_rows(gone.withColumnRenamed("node_id", "u"), n), "u", "left_anti").join(
            _by_rows(gone.withColumnRenamed("node_id", "v"), n), "v", "left_anti")
        bridges = spliced.where("u <> w").select("u", F.col("w").alias("v"))
        live = kept(stay.select("u", "v").unionByName(bridges).distinct())
        left = kept(left.join(_by_rows(gone, n), "node_id", "left_anti"))


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected component per node.

    Ends, chains and circles are taken out first (``_contract``).  In the rest, forward
    colouring: every node takes the largest id that reaches it; inside a colour, the nodes
    that reach the colour's own node form a component.  Done for all colours at once and
    repeated on what is left; the nodes of chains follow their neighbours in the end.
    Rounds of colouring follow the longest path of the contracted graph.
    """
    live = kept(edges.select("u", "v").where("u <> v").distinct())
    left = kept(edges.select(F.col("u").alias("node_id")).unionByName(edges.select(F.col("v").alias("node_id"))).where("node_id is not null").distinct())
    nothing = left.limit(0).select("node_id", F.col("node_id").alias("component"))
    done: list[DataFrame] = [nothing]
    splices: list[DataFrame] = []
    while True:
        singles: list[DataFrame] = []
        live, left = _contract(live, left, splices, singles)
        done += [s.select("node_id", F.col("node_id").alias("component")) for s in singles]
        size = left.count()
        if not size:
            break
        colour = kept(left.select("node_id", F.col("node_id").alias("c"), F.lit(True).alias("new")))
        while n := colour.where("new").count():
            moved = _by_rows(colour.where("new"), n).join(live, F.col("node_id") == F.col("u")).select(F.col("v").alias("node_id"), "c", F.lit(1).alias("n"))
            rows = colour.select("node_id", "c", F.lit(0).alias("n")).unionByName(moved)
            top = F.max(F.struct("c", (-F.col("n")).alias("old"))).alias("t")
            colour = kept(rows.groupBy("node_id").agg(top).select("node_id", "t.c", (F.col("t.old") < 0).alias("new")))
        same = live.join(_by_rows(colour.select(F.col("node_id").alias("u"), F.col("c").alias("cu")), size), "u").join(
            _by_rows(colour.select(F.col("node_id").alias("v"), F.col("c").alias("cv")), size), "v").where("cu = cv").select("u", "v")
        same = kept(same)
        found = kept(colour.where("node_id = c").select("node_id", F.col("c").alias("component")))
        step = found
        while n := step.count():
            step = _by_rows(step, n).join(same, F.col("node_id") == F.col("v")).select(F.col("u").alias("node_id"), "component").distinct()
            step = kept(step.join(_by_rows(found, size), "node_id", "left_anti"))
            found = kept(found.unionByName(step))
        done.append(found)
        left = kept(left.join(_by_rows(found, size), "node_id", "left_anti"))
        live = kept(live.join(_by_rows(left.withColumnRenamed("node_id", "u"), size), "u", "left_semi").join(
            _by_rows(left.withColumnRenamed("node_id", "v"), size), "v", "left_semi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = kept(out)
    for spliced in reversed(splices):
        a, b = out.select(F.col("node_id").alias("u"), F.col("component").alias("cu")), out.select(F.col("node_id").alias("w"), F.col("component").alias("cw"))
        n = out.count()
        own = spliced.join(_by_rows(a, n), "u").join(_by_rows(b, n), "w").select("node_id", F.when(F.col("cu") == F.col("cw"), F.col("cu")).otherwise(F.col("node_id")).alias("component"))
        out = kept(out.unionByName(own))
    return out


def largest_component(edges: DataFrame, strong: bool = True) -> DataFrame:
    """Nodes of the largest component (the one with the larger id on ties)."""
    parts = kept(strong_components(edges) if strong else weak_components(edges))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("component"))
    return parts.join(best, "component", "left_semi").select("node_id")


# ------------------------------------------------------------------- mid-block nodes
def _segments(path: Column) -> Column:
    """Consecutive vertex pairs with planar length and start offset."""
    def build(p: Column) -> Column:
        n = F.size(p) - 1
        raw = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(
            a.alias("a"), b.alias("b"), F.hypot(b["lat"] - a["lat"], b["lon"] - a["lon"]).alias("len")))
        return let(raw, lambda r: F.zip_with(r, F.slice(running_sums(F.transform(r, lambda x: x["len"])), F.lit(1), F.size(r)), lambda x, off: F.struct(
            x["a"].alias("a"), x["b"].alias("b"), x["len"].alias("len"), off.alias("off"))))

    return let(path, build)


def _share(s: Column, lat: Column, lon: Column) -> Column:
    """Share of a segment before its point nearest to (lat, lon)."""
    dy, dx = s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"]
    dot = (lat - s["a"]["lat"]) * dy + (lon - s["a"]["lon"]) * dx
    return F.when(s["len"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (s["len"] * s["len"]))))


def _distance_to(s: Column, lat: Column, lon: Column) -> Column:
    """Planar distance of a point from one segment, without lambda functions."""
    t = _share(s, lat, lon)
    dy, dx = s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"]
    return F.hypot(lat - (s["a"]["lat"] + dy * t), lon - (s["a"]["lon"] + dx * t))


def project_on(path: Column, lat: Column, lon: Column) -> Column:
    """Nearest point of a polyline: planar distance, offset along it, coordinates."""
    def onto(s: Column) -> Column:
        dy, dx = s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"]
        return let(_share(s, lat, lon), lambda t: let(
            F.struct((s["a"]["lat"] + dy * t).alias("lat"), (s["a"]["lon"] + dx * t).alias("lon")),
            lambda q: F.struct(F.hypot(lat - q["lat"], lon - q["lon"]).alias("dist"), (s["off"] + s["len"] * t).alias("along"), q["lat"].alias("lat"), q["lon"].alias("lon"))))

    return F.array_min(F.transform(_segments(path), onto))


def _pieces(edges: DataFrame) -> DataFrame:
    """Boxes of the streets' pieces, with their segment and, if given, the streets' pos.  A segment longer than the mean of all is cut into
    pieces of that extent, so a long slanting street has no box that spans everything; there
    are at most twice as many pieces as segments."""
    wide = lambda s: F.greatest(F.abs(s["b"]["lat"] - s["a"]["lat"]), F.abs(s["b"]["lon"] - s["a"]["lon"]))
    pos = [c for c in ("pos",) if c in edges.columns]
    segments = kept(edges.select(*pos, F.explode(_segments(F.col("geometry"))).alias("_s")))
    step = segments.agg(F.avg(wide(F.col("_s")))).first()[0] or 1.0
    n = F.greatest(F.lit(1), F.ceil(wide(F.col("_s")) / step)).cast("int")
    at = lambda c, i: F.col(f"_s.a.{c}") + (F.col(f"_s.b.{c}") - F.col(f"_s.a.{c}")) * i / F.col("_n")
    cut_up = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    box = {"south": F.least(at("lat", F.col("_i") - 1), at("lat", F.col("_i"))), "west": F.least(at("lon", F.col("_i") - 1), at("lon", F.col("_i"))),
           "north": F.greatest(at("lat", F.col("_i") - 1), at("lat", F.col("_i"))), "east": F.greatest(at("lon", F.col("_i") - 1), at("lon", F.col("_i")))}
    return cut_up.select(*pos, F.col("_s").alias("segment"), *[x.alias(c) for c, x in box.items()])


def nearest_edge(pois: DataFrame, edges: DataFrame) -> DataFrame:
    """Nearest street (planar degrees) of every place (place_id, pos, lat, lon); equal
    distances (to 13 digits) go to the smaller (u, v, k)."""
    # of streets of one shape the smallest can be the nearest
    shapes = edges.groupBy("geometry").agg(F.min(F.struct("u", "v", "k")).alias("pos"))
    items = _pieces(shapes).withColumn("root", F.lit(0))
    asks = pois.select(F.col("place_id").alias("rid"), "pos", "lat", "lon", F.lit(0).alias("root"), F.lit(1).alias("k"))
    # a street's distance is that of its nearest segment, one of whose pieces no bound can drop
    exact = -F.round(_distance_to(F.col("i_segment"), F.col("lat"), F.col("lon")), 13)
    found = best_k(kept(asks), build_tree(items, leaf_items=8), lambda s, d: -d, exact, plane_bounds)
    return found.select(F.col("rid").alias("place_id"), "pos", "lat", "lon", "i_pos.u", "i_pos.v", "i_pos.k", (-F.col("score")).alias("dist"))


def _cut_line(path: Column, lo: Column, hi: Column) -> Column:
    """Part of a polyline between two offsets."""
    def part(segs: Column) -> Column:
        def at(x: Column) -> Column:
            inside = F.filter(segs, lambda s: (s["off"] <= x) & (x <= s["off"] + s["len"]))
            return let(F.coalesce(F.try_element_at(inside, F.lit(1)), F.element_at(segs, -1)), lambda s: let(
                F.when(s["len"] == 0, F.lit(0.0)).otherwise((x - s["off"]) / s["len"]),
                lambda t: F.struct((s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * t).alias("lat"), (s["a"]["lon"] + (s["b"]["lon"] - s["a"]["lon"]) * t).alias("lon"))))

        middle = F.transform(F.filter(segs, lambda s: (s["off"] > lo) & (s["off"] < hi)), lambda s: s["a"])
        return F.concat(F.array(at(lo)), middle, F.array(at(hi)))

    return let(_segments(path), part)


def split_edges(pois: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert places as mid-block nodes; returns (new nodes, all edges).

    Each place is projected on its nearest street.  The hit edge and every edge in
    the opposite direction are replaced by a chain over the places, ordered along
    it (the start before and the far end after places at the same offset); piece
    lengths are proportional, at least 0.1.  A new node's id is -(pos + 1).
    """
    hits = kept(nearest_edge(pois, edges))
    street = [F.least("u", "v").alias("s0"), F.greatest("u", "v").alias("s1")]
    first = hits.groupBy(*street).agg(F.min_by(F.struct("u", "v", "k"), "pos").alias("rep"))
    mine = hits.select(*street, "place_id", "pos", "lat", "lon").join(first, ["s0", "s1"]).select("place_id", "pos", "lat", "lon", "rep.*")
    lines = edges.select("u", "v", "k", "length_m", "geometry")
    spots = mine.join(lines, ["u", "v", "k"]).withColumn("_q", project_on(F.col("geometry"), F.col("lat"), F.col("lon"))).select(
        (-(F.col("pos") + 1)).alias("node_id"), "place_id", "pos", "u", "v", "k", F.col("_q.lat").alias("lat"), F.col("_q.lon").alias("lon"))
    spots = kept(spots)
    reps = spots.select("u", "v", "k").distinct()
    reverse = edges.select("u", "v", "k").join(reps.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct(), ["u", "v"], "left_semi")
    split = reps.unionByName(reverse.select("u", "v", "k")).distinct()
    target = kept(split.join(lines, ["u", "v", "k"]))
    total = F.aggregate(_segments(F.col("geometry")), F.lit(0.0), lambda acc, s: acc + s["len"])
    target = target.withColumn("total", let(total, lambda x: F.when(x == 0, F.lit(1e-12)).otherwise(x)))
    ends = F.explode(F.array(
        F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("r"), F.col("u").cast("long").alias("node"), F.lit(-1).cast("long").alias("o")),
        F.struct(F.col("total").alias("p"), F.lit(2).alias("r"), F.col("v").cast("long").alias("node"), F.lit(-1).cast("long").alias("o"))))
    whole = target.select("u", "v", "k", "total", ends.alias("e")).select("u", "v", "k", "total", "e.*")
    pts = spots.select(F.least("u", "v").alias("s0"), F.greatest("u", "v").alias("s1"), F.col("node_id").alias("node"), F.col("pos").cast("long").alias("o"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    on = target.withColumns({"s0": F.least("u", "v"), "s1": F.greatest("u", "v")}).join(pts, ["s0", "s1"])
    along = F.greatest(F.lit(0.0), F.least(F.col("total"), project_on(F.col("geometry"), F.col("la"), F.col("lo"))["along"]))
    inner = on.select("u", "v", "k", "total", along.alias("p"), F.lit(1).alias("r"), "node", "o")
    chain = previous(whole.unionByName(inner), ["u", "v", "k"], ["p", "r", "o"], F.floor(F.col("p") / F.col("total") * 64), F.struct("p", "node"), "_a")
    pieces = chain.where(F.col("_a").isNotNull() & (F.col("_a.node") != F.col("node"))).select(
        "u", "v", "k", F.col("_a.node").alias("a"), F.col("node").alias("b"), F.col("_a.p").alias("pa"), F.col("p").alias("pb"))
    cut_up = pieces.join(target, ["u", "v", "k"])
    far = F.element_at("geometry", -1)
    length = F.coalesce("length_m", haversine_km(F.col("geometry")[0]["lat"], F.col("geometry")[0]["lon"], far["lat"], far["lon"]) * 1000.0)
    new = cut_up.select(
        F.col("a").alias("u"), F.col("b").alias("v"), "k", F.greatest(F.lit(0.1), length * (F.col("pb") - F.col("pa")) / F.col("total")).alias("length_m"),
        _cut_line(F.col("geometry"), F.col("pa"), F.col("pb")).alias("geometry"))
    whole_lines = lines.join(split, ["u", "v", "k"], "left_anti")
    nodes = spots.select("node_id", "place_id", "lat", "lon", F.lit(False).alias("is_base"))
    return nodes, whole_lines.select("u", "v", "k", "length_m", "geometry").unionByName(new)


def network_bounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bounds, centre and counts of the network; inserted places are not base nodes."""
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    return nodes.agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"),
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.count(F.lit(1)).alias("num_nodes"),
        F.sum(F.col("is_base").cast("long")).alias("num_base_nodes"),
    ).withColumn("num_edges", n_edges)
