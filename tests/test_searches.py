"""Searches over places: what is dropped beforehand, what is sent to all executors."""

import random

from pyspark.sql import functions as F

from tripwise.operators import boxtree, network, ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowded(spark, n=60):
    rows = [("a", i, i, 1.0, 2.0, 1.0, 2.0, (i * 7) % n / 10.0) for i in range(n)]
    return spark.createDataFrame(rows, "root string, place_id long, pos long, south double, west double, north double, east double, s double")


def test_a_spot_keeps_its_best_items_only(spark):
    items = crowded(spark)
    left = sorted(r.s for r in boxtree.drop_copies(items, 3).collect())
    assert left == [5.7, 5.8, 5.9]
    flat = {r.pos for r in boxtree.drop_copies(items, 3, flat=True).collect()}
    assert {0, 1, 2} <= flat and len(flat) <= 6


def test_large_sides_are_never_broadcast(spark):
    side = spark.createDataFrame([(1, 2)], "cell long, x long")
    left = spark.range(5).withColumnRenamed("id", "cell")
    assert "BroadcastHashJoin" in plan(left.join(boxtree._joined_by_size(side, 10, 0), "cell"))
    large = plan(left.join(boxtree._joined_by_size(side, boxtree.SENT_ROWS, 10), "cell"))
    assert "SortMergeJoin" in large and "BroadcastHashJoin" not in large


def test_key_word_affinity_does_not_broadcast_places(spark):
    from tripwise.plans.ranking_queries import keyword_affinity
    from tripwise.plans.tables import Tables

    joined = plan(keyword_affinity(Tables(spark, "/root/testdata/sf0.001")))
    assert "SortMergeJoin" in joined


def test_streamed_key_words_do_not_broadcast_places(spark):
    from tripwise.plans.ranking_queries import places
    from tripwise.plans.tables import Tables
    from tripwise.streaming.jobs import rated_words

    t = Tables(spark, "/root/testdata/sf0.001")
    joined = plan(rated_words(t.feedback, places(t)).select("keyword"))
    assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined


def test_oracle_ranking_of_crowded_spots(spark):
    """All pairs give the same lists; one user does not care for ratings at all."""
    rng = random.Random(4)
    places = [(i, i, "cafe", 40.7 + (i % 5) * 0.01, -74.0 + (i % 3) * 0.01, rng.choice([3.0, 3.5, 4.0, 4.5]) + i % 7 * 0.01) for i in range(200)]
    users = [(u, "cafe_friend", 40.7 + u * 0.003, -74.0 + u * 0.002, 0.0 if u == 3 else 0.5 + u * 0.1) for u in range(12)]
    place = spark.createDataFrame(places, "place_id long, pos long, category string, lat double, lon double, rating double")
    user = spark.createDataFrame(users, "user_id long, subtype string, lat double, lon double, pref double")
    asks = user.select(F.col("user_id").alias("rid"), "user_id", "subtype", "lat", "lon")
    known = user.select("user_id", "subtype", "pref", F.lit(0.2).alias("bonus"), F.lit(0.1).alias("intrinsic"),
                        F.lit(0.9).alias("pref_time"), F.lit(1.0).alias("pref_cost"), F.lit(15.0).alias("vot"))
    got = {(r.rid, r["rank"]): r.place_id for r in ranking.rank_oracle(asks, place, known, 5).collect()}
    every = ranking.pois_by_subtype(place).where("subtype = 'cafe_friend'").select("place_id", "pos", "rating", F.col("lat").alias("y"), F.col("lon").alias("x"))
    w = ranking.P.ORACLE_RANK
    per_km = 0.9 * 15.0 / max(1.0, w["speed_kmh"]) + w["cost_per_km"]
    rows = user.crossJoin(every).select("user_id", "place_id", "pos", (
        F.col("rating") / 5.0 * F.col("pref") - per_km * ranking.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).alias("v")).collect()
    for u in range(12):
        mine = sorted((r for r in rows if r.user_id == u), key=lambda r: (-round(r.v, 12), r.pos))[:5]
        assert [got[u, i] for i in range(1, 6)] == [r.place_id for r in mine]


def test_long_streets_are_cut_into_pieces(spark):
    rng = random.Random(9)
    def line(a, b, c, d):
        return [{"lat": a, "lon": b}, {"lat": c, "lon": d}]
    lines = [(i, i + 1, 0, line(y := rng.random(), x := rng.random(), y + 0.01, x + 0.01)) for i in range(150)]
    lines += [(1000 + i, 2000 + i, 0, line(0.0, i / 10, 1.0, i / 10 + 0.3)) for i in range(8)]
    lines += [(u + 5000, v + 5000, k, g) for u, v, k, g in lines[:40]]  # other streets of the same shape
    edges = spark.createDataFrame(lines, "u long, v long, k int, geometry array<struct<lat: double, lon: double>>")
    boxes = network._pieces(edges).select((F.col("north") - F.col("south")).alias("h")).collect()
    assert max(r.h for r in boxes) < 0.1 and len(boxes) <= 2 * len(lines)
    spots = [(i, i, rng.random(), rng.random()) for i in range(60)]
    pois = spark.createDataFrame(spots, "place_id long, pos long, lat double, lon double")
    got = {r.place_id: (r.u, r.v, r.k) for r in network.nearest_edge(pois, edges).collect()}

    def away(lat, lon, g):
        (ay, ax), (by, bx) = [(p["lat"], p["lon"]) for p in g]
        dy, dx = by - ay, bx - ax
        t = max(0.0, min(1.0, ((lat - ay) * dy + (lon - ax) * dx) / (dy * dy + dx * dx)))
        return round(((lat - ay - dy * t) ** 2 + (lon - ax - dx * t) ** 2) ** 0.5, 13)

    for i, _, lat, lon in spots:
        assert got[i] == min((away(lat, lon, g), u, v, k) for u, v, k, g in lines)[1:]


def test_requests_are_not_sent_to_the_driver(spark):
    """Read back, many requests look smaller than a few roots: the roots are what is sent."""
    from tripwise.operators import ranking as R
    from tripwise.session import kept

    requests = kept(spark.createDataFrame([(i, i, "cafe_friend", 40.7, -74.0) for i in range(3)], "rid long, user_id long, subtype string, lat double, lon double")
                    .selectExpr("*", "array('a') AS query_keywords", "array('b') AS interest_keywords", "'s' AS source"))
    places = spark.range(60).selectExpr("id AS place_id", "id AS pos", "'cafe_friend' AS subtype", "40.7D + id / 1000 AS lat", "-74.0D AS lon", "array('w' || id, 'coffee') AS keywords", "0.5D AS norm")
    candidates, personal = R._classes(places), R._Personal(requests, None, None, "s")
    asks = R._asks(requests, candidates, personal, 2)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan(asks).splitlines() if "BroadcastHashJoin [subtype" in line]
    assert joins and all("BuildRight" in line for line in joins)
    rated = spark.createDataFrame([(0, 1, 0.5)], "user_id long, place_id long, aff double")
    own = R._own_pairs(kept(asks), candidates, R._Personal(requests, rated, None, "s"), ["place_id"])
    assert "BuildLeft" not in plan(own)
    assert asks.count() == 180


def test_nearest_edge_scores_segments_without_lambdas(spark):
    """Bent streets: a segment's distance is that of the projection on the whole line's nearest part."""
    from tripwise.operators import network as N

    lines = [(1, 2, 0, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]), (2, 3, 0, [(1.0, 1.0), (1.0, 1.0), (2.0, 0.0)]), (3, 4, 0, [(3.0, 0.0), (3.0, 3.0)])]
    edges = spark.createDataFrame(lines, "u long, v long, k int, geometry array<struct<lat:double,lon:double>>")
    spots = spark.createDataFrame([(i, i, (i * 7 % 11) * 0.3, (i * 5 % 13) * 0.25) for i in range(40)], "place_id long, pos long, lat double, lon double")
    got = {r.place_id: (r.u, r.dist) for r in N.nearest_edge(spots, edges).collect()}
    all_ = spots.crossJoin(edges).withColumn("d", F.round(N.project_on(F.col("geometry"), F.col("lat"), F.col("lon"))["dist"], 13))
    want = {r.place_id: (r.b.u, r.b.d) for r in all_.groupBy("place_id").agg(F.min(F.struct("d", "u")).alias("b")).collect()}
    assert got == want
    assert "geometry" not in N._pieces(edges.select(F.struct("u", "v", "k").alias("pos"), "geometry")).columns


def test_large_sets_of_nodes_are_joined_by_sorting(spark, monkeypatch):
    """Two circles with a bridge, some ends: the same components whichever way sides are joined."""
    rows = [(i, (i + 1) % 9) for i in range(9)] + [(20 + i, 20 + (i + 1) % 5) for i in range(5)] + [(0, 20), (3, 40), (41, 3), (1, 5), (5, 1)]
    edges = spark.createDataFrame(rows, "u long, v long")
    want = sorted(map(tuple, network.strong_components(edges).collect()))
    monkeypatch.setattr(network, "SENT_ROWS", 0)
    assert "SortMergeJoin" in plan(edges.join(network._by_rows(edges.select("u"), 1), "u"))
    assert sorted(map(tuple, network.strong_components(edges).collect())) == want
    assert sorted(sum(x == c for _, x in want) for c in {c for _, c in want}) == [1, 1, 5, 9]
