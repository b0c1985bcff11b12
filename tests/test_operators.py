"""Operators against brute force and on edge cases."""

import heapq
import math
import random

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import catalog as C
from tripwise.operators import choice as H
from tripwise.operators import feedback as B
from tripwise.operators import gate as G
from tripwise.operators import metrics as M
from tripwise.operators import network as D
from tripwise.operators import ordering
from tripwise.operators import organic as O
from tripwise.operators import overlay as V
from tripwise.operators import population as N
from tripwise.operators import ranking as R
from tripwise.operators import trajectory as J
from tripwise.operators.ordering import exact_percentiles, ordinal, previous, running_total

c = F.col


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


# ------------------------------------------------------------------ ordered helpers
def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(300), i, rng.randrange(-3, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    bucket = F.floor(c("t") / 40)
    got = running_total(df, ["k"], ["t", "id"], bucket, c("v"), "run")
    got = previous(got, ["k"], ["t", "id"], bucket, c("v"), "before")
    got = ordinal(got, ["k"], ["t", "id"], bucket, "n")
    state: dict = {}
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, before, n = state.get(k, (0, None, 0))
        want[i] = (total + v, before, n + 1)
        state[k] = (total + v, v, n + 1)
    assert {r.id: (r.run, r.before, r.n) for r in got.collect()} == want


def test_exact_percentiles_interpolate(spark):
    rng = random.Random(2)
    values = [round(rng.expovariate(1), 3) for _ in range(501)] + [1.0] * 300
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, v double")
    got = {(r.g, r.share): r.percentile for r in exact_percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    s = sorted(values)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        x = share * (len(s) - 1)
        lo = int(x)
        want = s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (x - lo)
        assert abs(got["a", share] - want) < 1e-9 and got["b", share] == 7.0


# ------------------------------------------------------------------ metrics
def gini_of(spark, values):
    rows = M.gini(spark.createDataFrame([("g", float(v)) for v in values], "g string, v double"), ["g"], "v").collect()
    return rows[0].gini


def test_gini_edge_cases(spark):
    assert gini_of(spark, [3]) == 0 and gini_of(spark, [0, 0, 0]) == 0 and abs(gini_of(spark, [2, 2, 2])) < 1e-12
    assert abs(gini_of(spark, [0, 0, 0, 1]) - 0.75) < 1e-12
    assert abs(gini_of(spark, [-1, 0, 2]) - gini_of(spark, [0, 1, 3])) < 1e-12
    assert abs(gini_of(spark, [1, 2, 5]) - gini_of(spark, [10, 20, 50])) < 1e-12


def test_regret_default_without_observations(spark):
    empty = spark.createDataFrame([], "r double")
    assert M.calibrate_epsilon(empty, "r").first().epsilon == 0.3


# ------------------------------------------------------------------ catalog
def test_packed_places(spark):
    raw = spark.createDataFrame([
        ("40.7", "-74", "", "one|two", "a|b|c", "999999|722515.0|722511", "", ""),
        ("40.7", "-74", "", "only", "x|y", "1|722511", None, None),
        ("40.7", "-74", "", "art", "m", None, "Museums", "Other"),
        ("abc", "-74", "", "bad", "z", "722511", "", ""),
        ("40.7", "-74", "", None, "q", "722511", "", ""),
    ], ", ".join(f"{n} string" for n in ("LATITUDE", "LONGITUDE", "CITY", "LOCATION_NAME", "PLACEKEY", "NAICS_CODE", "SUB_CATEGORY", "TOP_CATEGORY")))
    got = {r.place_id: (r.name, r.category) for r in C.filter_pois(raw).collect()}
    assert got == {"b": ("two", "cafe"), "y": ("only", "restaurant"), "m": ("art", "museum")}
    assert "q" in {r.place_id for r in C.filter_pois(raw, compat_nan=True).collect()}


# ------------------------------------------------------------------ ranking
def make_places(spark, n, seed=3, copies=0):
    rng = random.Random(seed)
    cats = ["restaurant", "food_takeout", "live_music", "cafe"]
    rows = [(i, i, rng.choice(cats), 40.7 + rng.random() * 0.1, -74 + rng.random() * 0.1, round(rng.uniform(2.8, 4.9), 2), rng.randrange(20, 5000), rng.uniform(10, 9000)) for i in range(n)]
    rows += [(n + i, n + i, "restaurant", 40.75, -73.95, 4.9, 4999, 5000.0) for i in range(copies)]
    df = spark.createDataFrame(rows, "place_id long, pos long, category string, lat double, lon double, rating double, review_count long, popularity double")
    return rows, df.withColumn("keywords", C.keywords_of(c("category")))


def make_requests(spark, n, subtype="food_takeout"):
    rng = random.Random(4)
    rows = [(i, i, subtype, 40.7 + rng.random() * 0.1, -74 + rng.random() * 0.1) for i in range(n)]
    df = spark.createDataFrame(rows, "rid long, user_id long, subtype string, lat double, lon double")
    return rows, df.withColumns({"query_keywords": F.array().cast("array<string>"), "interest_keywords": F.array(F.lit("dinner"))})


def brute_prominence(places, requests, aff, k):
    cand = [p for p in places if p[2] in P.SUBTYPE_CATEGORIES["food_takeout"]]
    logs = [math.log1p(p[6]) for p in cand]
    lo, hi = min(logs), max(logs)
    q, interest = set(P.SUBTYPE_KEYWORDS["food_takeout"]), {"dinner"}
    out = {}
    for rid, user, _, lat, lon in requests:
        scored = []
        for p, lg in zip(cand, logs):
            prom = 0.55 * p[5] / 5 + 0.45 * (lg - lo) / (hi - lo)
            ws = set(P.CATEGORY_KEYWORDS[p[2]])
            rel = 0.75 * len(ws & q) / len(ws | q) + 0.25 * len(ws & interest) / len(ws | interest)
            pers = max(0, min(1, 0.5 * (0.6 * aff.get((user, p[0]), 0.0) + 1)))
            scored.append((-(0.9 * (0.45 * prom + 0.35 * rel + 0.2 * math.exp(-km((lat, lon), (p[3], p[4])) / 5)) + 0.1 * pers), p[1]))
        out[rid] = [pos for _, pos in sorted(scored)[:k]]
    return out


def test_rank_prominence_equals_scoring_every_pair(spark):
    places, pdf = make_places(spark, 500, copies=200)
    requests, rdf = make_requests(spark, 40)
    rng = random.Random(5)
    aff = {(u, p[0]): rng.uniform(-1, 1) for u in range(10) for p in rng.sample(places, 40)}
    adf = spark.createDataFrame([(u, p, a) for (u, p), a in aff.items()], "user_id long, place_id long, aff double")
    got: dict = {}
    for r in R.rank_prominence(rdf, pdf, 4, adf).orderBy("rid", "rank").collect():
        got.setdefault(r.rid, []).append(r.pos)
    assert got == brute_prominence(places, requests, aff, 4)


def test_rank_lengths(spark):
    places, pdf = make_places(spark, 60)
    _, rdf = make_requests(spark, 3)
    assert R.rank_prominence(rdf, pdf, 0).count() == 3  # at least one
    prefs = R.oracle_bonuses(spark.createDataFrame([], "user_id long, intrinsic double, escape double, pref double, pref_time double, pref_cost double, vot double"))
    assert R.rank_rating_fallback(rdf, pdf, prefs, 0).count() == 0  # plain slice
    assert R.rank_oracle(rdf, pdf, prefs, 3).count() == 0
    _, none = make_requests(spark, 3, "museum")
    assert R.rank_prominence(none, pdf, 3).count() == 0


def test_organic_choice_follows_its_probabilities(spark):
    places, pdf = make_places(spark, 150)
    nodes = spark.createDataFrame([(i, 40.7 + i * 0.001, -74.0, True) for i in range(5)], "node_id long, lat double, lon double, is_base boolean")
    n = 4000
    ask = spark.range(n).select(c("id").alias("rid"), F.lit("cafe_friend").alias("subtype"), F.lit(40.73).alias("lat"), F.lit(-73.98).alias("lon"))
    got = {r.place_id: r.n for r in O.organic_choice(ask, pdf, nodes).groupBy("place_id").agg(F.count("*").alias("n")).collect()}
    cand = [p for p in places if p[2] == "cafe"]
    w = {p[0]: math.exp(-km((40.73, -73.98), (p[3], p[4])) / 3) for p in cand}
    total = sum(w.values())
    chi = sum((got.get(p, 0) - n * x / total) ** 2 / (n * x / total) for p, x in w.items())
    assert sum(got.values()) == n and set(got) <= set(w) and chi < len(w) + 5 * math.sqrt(2 * len(w))
    lost = O.organic_choice(ask.limit(20).withColumn("subtype", F.lit("museum")), pdf, nodes).collect()
    assert len(lost) == 20 and all(r.place_id is None and r.p_lon == -74.0 for r in lost)


# ------------------------------------------------------------------ gate
def test_gate_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.5, 1.0, 0.0), (1.0, 0.5, 1.0)], "v double, c double, s double")
    rows = df.select(G.pup(c("v"), c("c"), c("s")).alias("p"), G.expected_regret(c("v"), c("c"), c("s")).alias("r")).collect()
    assert [r.p for r in rows[:2]] == [1.0, 0.0] and [r.r for r in rows[:2]] == [0.0, 0.5]
    assert rows[2].p > 0.5 and rows[2].r > 0


# ------------------------------------------------------------------ feedback
def test_clamp_does_not_commute(spark):
    rows = [(i, i, 1, 1, "google_maps", "like", 2.0) for i in range(12)] + [(12, 12, 1, 1, "google_maps", "dislike", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, place_id long, source string, kind string, strength double").withColumn("ts", F.timestamp_seconds("s"))
    places = spark.createDataFrame([(1,)], "place_id long")
    for width in (1, 5, 1000):
        got = B.place_affinity(events, places, B.ts_bucket(seconds=width)).collect()
        assert len(got) == 1 and abs(got[0].aff - (1.0 - 0.24)) < 1e-12
    assert B.place_affinity(events, places.where("place_id < 0")).count() == 0


def test_travel_cost_chunks_equal_a_walk(spark):
    rng = random.Random(6)
    rows = [(i, i * 7, rng.randrange(2), rng.uniform(0, 20), rng.randrange(0, 60), rng.uniform(-1, 1)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, money double, travel_min long, satisfaction double").withColumn("ts", F.timestamp_seconds("s"))
    want: dict = {}
    for _, _, u, money, t, s in rows:
        n, ema, v = want.get(u, (0, 0.0, 15.0))
        ema = 0.85 * ema + 0.15 * (money + t / 60 * v)
        if t > 0 and s < -0.2:
            v = min(50.0, v * (1 + 0.05 * abs(s)))
        elif t > 20 and s > 0.3:
            v = max(5.0, v * (1 - 0.03 * s))
        want[u] = (n + 1, ema, v)
    first = events.where("event_id < 90")
    resumed = B.travel_cost_state(events.where("event_id >= 90"), initial=B.travel_cost_state(first))
    for got in (B.travel_cost_state(events, bucket=B.ts_bucket(seconds=50)), resumed):
        for r in got.collect():
            n, ema, v = want[r.user_id]
            assert r.n == n and abs(r.avg_travel_cost - ema) < 1e-9 and abs(r.vot - v) < 1e-9


# ------------------------------------------------------------------ trajectories
def test_stays_of_odd_days(spark):
    schema = "treatment string, seed long, day long, agent_id long, trip_key long, t0 long, t1 long, lat1 double, lon1 double, purpose string"
    trips = spark.createDataFrame([("a", 1, 0, 1, 1, 100, 130, 1.0, 1.0, "work"), ("a", 1, 0, 1, 2, 120, 160, 2.0, 2.0, "leisure"),
                                   ("a", 1, 0, 1, 3, 1430, 1450, 3.0, 3.0, "home")], schema)
    homes = spark.createDataFrame([("a", 1, 0, 1, 0.0, 0.0), ("a", 1, 0, 2, 9.0, 9.0)], "treatment string, seed long, day long, agent_id long, lat double, lon double")
    got = sorted((r.agent_id, r.t0, r.t1, r.lat, r.state) for r in J.stays(trips, homes).collect())
    assert got == [(1, 0, 100, 0.0, "home"), (1, 160, 1430, 2.0, "leisure"), (1, 1450, 1440, 3.0, "home"), (2, 0, 1440, 9.0, "home")]


def test_interval_join_equals_comparison(spark):
    rng = random.Random(7)
    spans = [(rng.randrange(3), i, rng.randrange(1400), rng.randrange(0, 200)) for i in range(60)]
    points = [(rng.randrange(3), i, float(rng.randrange(1500))) for i in range(60)]
    a = spark.createDataFrame([(k, i, t, t + w) for k, i, t, w in spans], "k int, id int, t0 int, t1 int")
    b = spark.createDataFrame(points, "k int, p int, t double")
    got = {(r.p, r.id) for r in J.interval_join(b, a, ["k"]).collect()}
    assert got == {(p, i) for k, p, t in points for k2, i, t0, w in spans if k == k2 and t0 <= t <= t0 + w}


def test_a_move_beats_a_stay_on_the_boundary(spark):
    m = spark.createDataFrame([("a", 1, 1, 1, 10, 20, "car")], "treatment string, seed long, agent_id long, trip_key long, t0 long, t1 long, mode string")
    m = m.withColumn("path", F.array(F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), F.struct(F.lit(0.0).alias("lat"), F.lit(1.0).alias("lon"))))
    s = spark.createDataFrame([("a", 1, 1, 0, 10, 5.0, 5.0, "home")], "treatment string, seed long, agent_id long, t0 long, t1 long, lat double, lon double, state string")
    got = {r.t: (r.state, round(r.lon, 9)) for r in J.positions_at(m, s, [5.0, 10.0, 15.0, 30.0]).collect()}
    assert got == {5.0: ("home", 5.0), 10.0: ("in_transit", 0.0), 15.0: ("in_transit", 0.5)}


# ------------------------------------------------------------------ network
def graph(spark, pairs):
    return spark.createDataFrame([(u, v, 0, float(w)) for u, v, w in pairs], "u long, v long, k int, length_m double")


def test_folds_of_a_very_busy_key_stay_split(spark):
    """One user with 60,000 busy hours: no row holds more than WIDTH maps, values as by hand."""
    n = 60_000
    events = spark.range(n).select(
        F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600 * 3).alias("ts"), (F.col("id") % 13).cast("double").alias("money"),
        (F.col("id") % 61).cast("double").alias("travel_min"), ((F.col("id") * 7919 % 201 - 100) * 0.01).alias("satisfaction"), ((F.col("id") * 31 % 41 - 20) * 0.01).alias("delta"))
    chunks = events.select("user_id", B.ts_bucket().alias("_b"), F.struct(F.col("delta").alias("s"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi")).alias("_m"))
    levels = ordering.up_sweep(chunks, ["user_id"], B._then_clamped)
    assert [level.agg(F.max(F.size("_c"))).first()[0] <= ordering.WIDTH for level in levels] == [True] * (ordering.LEVELS + 1)
    x, ema, vot = 0.0, 0.0, P.TRAVEL_COST["default_vot"]
    t = P.TRAVEL_COST
    for i in range(n):
        x = max(-1.0, min(1.0, x + (i * 31 % 41 - 20) * 0.01))
        minutes, s = i % 61, (i * 7919 % 201 - 100) * 0.01
        ema = (1 - t["rate"]) * ema + t["rate"] * (i % 13 + minutes / 60 * vot)
        if minutes > 0 and s < t["dislike"]:
            vot = min(t["vot_max"], vot * (1 + t["up"] * abs(s)))
        elif minutes > t["long_min"] and s > t["like"]:
            vot = max(t["vot_min"], vot * (1 - t["down"] * s))
    (aff,) = B.clamped_fold(events, ["user_id"], ["ts", "event_id"], B.ts_bucket()).collect()
    (cost,) = B.travel_cost_state(events).collect()
    assert abs(aff.aff - x) < 1e-9 and cost.n == n and abs(cost.vot - vot) < 1e-6 and abs(cost.avg_travel_cost - ema) < 1e-6


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(40), rng.randrange(40), 1) for _ in range(55)]
    reach: dict = {i: {i} for i in range(40)}
    for _ in range(40):
        for u, v, _w in pairs:
            reach[u] |= reach[v]
    seen = {x for u, v, _w in pairs if u != v for x in (u, v)}
    want = {}
    for i in seen:
        want[i] = frozenset(j for j in seen if j in reach[i] and i in reach[j])
    edges = graph(spark, [p for p in pairs if p[0] != p[1]])
    got: dict = {}
    for r in D.strong_components(edges).collect():
        got.setdefault(r.component, set()).add(r.node_id)
    assert {frozenset(x) for x in got.values()} == set(want.values())
    chain = graph(spark, [(i, i + 1, 1) for i in range(30)] + [(100, 101, 1)])
    assert sorted(r.node_id for r in D.largest_component(chain, strong=False).collect()) == list(range(31))


def test_long_circles_and_chains_need_few_rounds(spark, monkeypatch):
    """A circle of 5,000 nodes with a tail of 3,000 and a side way: rounds follow the log."""
    rounds = []
    monkeypatch.setattr(D, "kept", lambda df, name="kept", keep=D.kept: rounds.append(1) or keep(df, name))
    pairs = [(i, (i + 1) % 5000, 1) for i in range(5000)] + [(5000 + i, 5001 + i, 1) for i in range(3000)] + [(17, 5000, 1), (4000, 9000, 1), (9000, 1000, 1)]
    got = D.strong_components(graph(spark, pairs)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in got) == [1] * 3001 + [5001]
    assert len(rounds) < 260


def test_long_routes_are_walked_in_doubling_steps(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(D, "kept", lambda df, name="kept", keep=D.kept: rounds.append(1) or keep(df, name))
    edges = graph(spark, [(i, i + 1, 1) for i in range(1000)])
    nodes = spark.createDataFrame([(i, 40.0 + i / 100, -74.0, True) for i in range(1002)], "node_id long, lat double, lon double, is_base boolean")
    paths = D.shortest_paths(edges, spark.createDataFrame([(0,), (400,)], "src long"))
    ask = spark.createDataFrame([(0, 1000), (400, 403), (0, 1001), (5, 5)], "origin long, dest long")
    got = {(r.origin, r.dest): [round((p.lat - 40) * 100) for p in r.path] for r in D.route_geometry(ask, paths, edges, nodes).collect()}
    assert got == {(0, 1000): list(range(1001)), (400, 403): [400, 401, 402, 403], (0, 1001): [0, 1001], (5, 5): [5]}
    assert len(rounds) <= 2 * 11 + 2


def shortest_by_hand(pairs, src):
    best, heap = {}, [(0, src)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for u, v, w in pairs.get(n, ()):
                heapq.heappush(heap, (d + w, v))
    return best


def test_paths_through_cells(spark, monkeypatch):
    """A chain of 2,000 hops through cells, a ladder with targets, a graph that cells don't separate."""
    rng = random.Random(12)
    chain = [(i, i + 1, rng.randrange(5)) for i in range(2000)]
    ladder = [(n, m, rng.randrange(20)) for n in range(800) for m in (n ^ 1, n + 2, n - 2) if 0 <= m < 800 and rng.random() < 0.95]
    tangle = [(i, (i * 7 + k) % 300, 1 + i % 9) for i in range(300) for k in (1, 3, 5)]
    monkeypatch.setattr(V, "SOURCES", 2)
    blocks = [spark.createDataFrame(rows, "node long, cell long") for rows in ([(i, i // 40) for i in range(2001)], [(n, n // 80) for n in range(800)], [(n, n // 30) for n in range(300)])]
    for pairs, cells, top, sources, targets, levels in (
            (chain, blocks[0], 200, [0, 1500, 2000, 5000], None, 1), (ladder, blocks[1], 300, [0, 7, 799], {5, 500}, 1), (tangle, blocks[2], 700, [0, 5], None, 0)):
        monkeypatch.setattr(V, "TOP_EDGES", top)
        by_node = {}
        for p in pairs:
            by_node.setdefault(p[0], []).append(p)
        overlay = V.build_overlay(graph(spark, pairs), cells=cells)
        asked = None if targets is None else spark.createDataFrame([(t,) for t in targets], "node_id long")
        got = V.search(overlay, spark.createDataFrame([(s,) for s in sources], "src long"), asked).collect()
        want = {(s, n): float(d) for s in sources for n, d in shortest_by_hand(by_node, s).items() if targets is None or n in targets}
        found = {(r.src, r.node): r.dist_m for r in got}
        assert len(found) == len(got) and found == want
        assert overlay.levels == levels
        least = {}
        for u, v, w in pairs:
            least[u, v] = min(w, least.get((u, v), 1e9))
        for r in got if targets is None else []:
            assert r.src == r.node if r.pred is None else found[r.src, r.pred] + least[r.pred, r.node] == r.dist_m


def test_cells_grow_connected_and_bounded(spark):
    rng = random.Random(13)
    pairs = [(n, m, 1) for n in range(100) for m in (n + 1, n + 10) if m < 100 and (m % 10 or m == n + 10) and rng.random() < 0.9]
    cells: dict = {}
    for r in V.grow_cells(graph(spark, pairs), 12).collect():
        cells.setdefault(r.cell, set()).add(r.node)
    assert sorted(n for c in cells.values() for n in c) == sorted({x for p in pairs for x in p[:2]})
    assert max(map(len, cells.values())) <= 12 and len(cells) < 40
    for members in cells.values():
        seen, new = set(), {min(members)}
        while new:
            seen |= new
            new = {y for u, v, _ in pairs for x, y in ((u, v), (v, u)) if x in new and y in members} - seen
        assert seen == members


def test_routes_add_up(spark):
    rng = random.Random(9)
    pairs = [(i, (i * 3 + s) % 25, rng.randrange(1, 50)) for i in range(25) for s in (1, 2)]
    edges = graph(spark, pairs + [(0, 1, 500)])
    nodes = spark.createDataFrame([(i, 40.0 + i, -74.0 + i % 7, True) for i in range(26)], "node_id long, lat double, lon double, is_base boolean")
    dist = {i: {i: 0.0} for i in range(25)}
    for i in dist:
        for _ in range(25):
            for u, v, w in pairs:
                if u in dist[i] and dist[i][u] + w < dist[i].get(v, 1e18):
                    dist[i][v] = dist[i][u] + w
    paths = D.shortest_paths(edges, spark.createDataFrame([(0,), (7,)], "src long"))
    got = {(r.src, r.node): r.dist_m for r in paths.collect()}
    assert got == {(i, v): d for i in (0, 7) for v, d in dist[i].items()}
    ask = spark.createDataFrame([(0, 9), (7, 3), (7, 7), (0, 25)], "origin long, dest long")
    km_of = {(r.origin, r.dest): r.km for r in D.route_lengths(ask, paths, nodes).collect()}
    assert km_of[7, 7] == 0.0 and km_of[0, 9] == dist[0][9] / 1000 and abs(km_of[0, 25] - km((40, -74), (65, -70))) < 1e-6
    best = {}
    for u, v, w in pairs:
        best[u, v] = min(w, best.get((u, v), 1e9))
    for r in D.route_geometry(ask, paths, edges, nodes).collect():
        ids = [int(p.lat - 40) for p in r.path]
        if (r.origin, r.dest) == (0, 25):
            assert ids == [0, 25]
        else:
            assert ids[0] == r.origin and ids[-1] == r.dest
            assert sum(best[a, b] for a, b in zip(ids, ids[1:])) == dist[r.origin][r.dest]


def test_nearest_node_in_a_crowd(spark):
    rng = random.Random(10)
    nodes = [(i, 40 + rng.random() * 1e-3, -74 + rng.random() * 1e-3) for i in range(400)] + [(400 + i, 10 + rng.random() * 50, rng.uniform(-179, 179)) for i in range(100)]
    points = [(i, 40 + rng.random() * 1e-3, -74 + rng.random() * 1e-3) for i in range(30)] + [(30 + i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)]
    ndf = spark.createDataFrame([(*n, True) for n in nodes], "node_id long, lat double, lon double, is_base boolean")
    got = {r.p: r.node_id for r in D.nearest_node(spark.createDataFrame(points, "p long, lat double, lon double"), ndf).collect()}
    for p, lat, lon in points:
        at = (round(lat, 6), round(lon, 6))
        best = min(km(at, n[1:]) for n in nodes)
        assert km(at, nodes[got[p]][1:]) <= best + 1e-9


# ------------------------------------------------------------------ population, choice
def test_bootstrap_keeps_values_and_distinct_homes(spark):
    base = spark.createDataFrame([(f"P{i}", "low" if i % 2 else "high", "0", "0") for i in range(20)], "PersonaID string, Budget string, start_latitude string, start_longitude string")
    nodes = spark.createDataFrame([(i, 40 + i * 0.01, -74.0, True) for i in range(60)], "node_id long, lat double, lon double, is_base boolean")
    got = N.bootstrap_marginals(base, nodes, spark.range(1, 51).select(c("id").alias("idx"))).collect()
    assert len(got) == 50 and len({r.start_latitude for r in got}) == 50 and {r.Budget for r in got} == {"low", "high"}
    assert sorted(r.PersonaID for r in got)[0] == "SYN0001"


def test_default_switches(spark):
    one = spark.createDataFrame([("P1", "no car", "nightlife")], "PersonaID string, CarAccess string, PrimaryInterest string")
    r = N.persona_to_agent(one).first()
    assert (r.car_access, r.car_penalty, r.derived, r.intrinsic, r.walk_tolerance) == ("own car", 0.0, 1.0, 0.0, 15)
    assert 35000 <= r.income <= 74000 and 35 <= r.age <= 54


def test_regret_rule_prefers_the_dearest(spark):
    o = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("pos"), F.lit(g).alias("gen_cost")) for i, (m, g) in enumerate([("walk", 1.0), ("car", 5.0), ("bike", 3.0)])])
    r = spark.range(1).select(H.choose_regret(o).alias("a"), H.choose_regret(o, corrected=True).alias("b")).first()
    assert (r.a, r.b) == ("car", "walk")


# ------------------------------------------------------------------ ties, empty cells, sweeps
def test_ties_are_one_row(spark):
    """90 % equal values: the counted table has them once, and all measures agree."""
    from tripwise.operators import ordering

    rng = random.Random(3)
    values = [0.0] * 9000 + [rng.uniform(0, 5) for _ in range(1000)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
    counted = ordering.value_counts(df, ["g"], "v")
    assert counted.count() == 1001 and counted.agg(F.max("n")).first()[0] == 9000
    old, ordering.BLOCK_VALUES = ordering.BLOCK_VALUES, 50
    try:
        got = {r.share: r.percentile for r in exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.9, 0.95, 0.999, 1.0]).collect()}
        none = {r.share: r.percentile for r in exact_percentiles(df.where("v is not null"), [], "v", [0.95]).collect()}
        g = M.gini(df, ["g"], "v").first().gini
    finally:
        ordering.BLOCK_VALUES = old
    x = sorted(values)
    for share, p in got.items():
        at = share * (len(x) - 1)
        lo = math.floor(at)
        want = x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (at - lo)
        assert abs(p - want) < 1e-9
    assert abs(none[0.95] - got[0.95]) < 1e-12
    n, s = len(x), sum(x)
    assert abs(g - ((2 * sum((i + 1) * v for i, v in enumerate(x)) - (n + 1) * s) / (n * s))) < 1e-9


def test_empty_heatmap_cells_are_zero(spark):
    rows = [("a", "no_rs", 0.5), ("a", "x", 1.0), ("b", "no_rs", 0.25), ("c", "x", 2.0)]
    got = {(r.paradigm, r.treatment): r.delta for r in M.paradigm_heatmap(spark.createDataFrame(rows, "paradigm string, treatment string, mean_utility double")).collect()}
    assert got == {("a", "x"): 0.5, ("b", "x"): -0.25, ("c", "x"): 2.0}


def test_gate_sweep_counts_unserved_requests(spark):
    asked = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "rid long, seed long")
    rows = [(1, 0, 1, 0.2, 0.5, 0.4, 0.9), (1, 0, 2, 1.0, 0.1, 0.8, 0.1), (2, 0, 1, 0.0, 1.0, 0.1, 2.0)]
    answers = spark.createDataFrame(rows, "rid long, seed long, rank int, v_hat double, c_hat double, pup double, expected_regret double")
    limits = spark.createDataFrame([(50, 0.5)], "pct int, epsilon double")
    got = {(r.gate, r.threshold, r.seed): (round(r.mean_utility, 9), r.abstention_rate) for r in G.gate_sweep(answers, asked, (0.0, 0.3, 0.9), limits).collect()}
    assert got == {
        ("pup", 0.0, 0): (-0.65, 0.0), ("pup", 0.0, 1): (0.0, 1.0), ("pup", 0.3, 0): (-0.3, 0.5), ("pup", 0.3, 1): (0.0, 1.0),
        ("pup", 0.9, 0): (0.0, 1.0), ("pup", 0.9, 1): (0.0, 1.0), ("rm", 50.0, 0): (0.9, 0.5), ("rm", 50.0, 1): (0.0, 1.0)}
