"""Shortest paths on graphs that cells don't separate."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tripwise.operators import network as D
from tripwise.operators import overlay as V


def far(pairs, src):
    out = V.adjacency(pd.DataFrame([(u, v, w, 1, u) for u, v, w in pairs], columns=["u", "v", "w", "hops", "last"]))
    return {n: (d, h) for n, (d, h, _) in V.settle(out, [(0, 0, src, None)]).items()}


def test_relaxation_over_shards_and_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(V, "TOP_EDGES", 10)
    monkeypatch.setattr(V, "SHARD", 30)
    monkeypatch.setattr(V, "SOURCES", 2)
    monkeypatch.setattr(V, "CROWD", 20)
    draw = random.Random(3)
    pairs = [(u, draw.randrange(70), draw.choice([0, 1, 2, 7])) for u in range(60) for _ in range(3)]
    pairs = list({(u, v): (u, v, w) for u, v, w in pairs if u != v}.values())
    # text ids too: nothing may rely on numbers
    for kind in ("bigint", "string"):
        edges = spark.createDataFrame([(u, v, float(w)) for u, v, w in pairs], "u long, v long, length_m double")
        edges = edges.select(F.col("u").cast(kind), F.col("v").cast(kind), "length_m")
        overlay = V.build_overlay(edges)
        assert not overlay.small and overlay.levels == 0
        sources = spark.createDataFrame([(s,) for s in (0, 5, 999)], "src long").select(F.col("src").cast(kind))
        rows = V.search(overlay, sources).collect()
        weight = {(str(u), str(v)): w for u, v, w in pairs}
        named = {}
        for s in (0, 5, 999):
            for n, (d, h) in far(pairs, s).items():
                named[str(s), str(n)] = (d, h)
        assert {(str(r.src), str(r.node)): r.dist_m for r in rows} == {k: float(d) for k, (d, _) in named.items()}
        for r in rows:
            if r.src == r.node:
                assert r.pred is None
                continue
            d, h = named[str(r.src), str(r.pred)]
            assert (d + weight[str(r.pred), str(r.node)], h + 1) == named[str(r.src), str(r.node)]


def test_no_cells_are_grown_where_neighbourhoods_are_crowded(spark, monkeypatch):
    monkeypatch.setattr(V, "CROWD", 200)
    spread = spark.range(3000).selectExpr("id AS u", "explode(array((id * 7 + 1) % 3000, (id * 7 + 3) % 3000, (id * 7 + 5) % 3000)) AS v")
    assert V.crowded(spread)
    grid = spark.range(3600).selectExpr("id AS u", "explode(array(id + 1, id + 60)) AS v").where("v < 3600 AND (v % 60 <> 0 OR v - u = 60)")
    monkeypatch.setattr(V, "CROWD", 400)
    assert not V.crowded(grid)


def test_the_smallest_predecessor_comes_with_the_search(spark, monkeypatch):
    """Of equally long ways the smallest last node counts, with however many hops; steps of no length don't."""
    for name, value in (("TOP_EDGES", 10), ("SHARD", 30), ("SOURCES", 2), ("CROWD", 20)):
        monkeypatch.setattr(V, name, value)
    draw = random.Random(4)
    pairs = [(u, draw.randrange(70), draw.choice([0, 1, 2, 3])) for u in range(60) for _ in range(4)]
    pairs = list({(u, v): (u, v, w) for u, v, w in pairs if u != v}.values())
    for kind in ("bigint", "string"):
        edges = spark.createDataFrame([(u, v, w * 0.1) for u, v, w in pairs], "u long, v long, length_m double")
        edges = edges.select(F.col("u").cast(kind), F.col("v").cast(kind), "length_m")
        sources = spark.createDataFrame([(s,) for s in (0, 5, 999)], "src long").select(F.col("src").cast(kind))
        paths = D.shortest_paths(edges, sources, near=True)
        own = str if kind == "string" else int
        want = {}
        for s in (0, 5, 999):
            d = {n: x for n, (x, _) in far(pairs, s).items()}
            for n in d:
                want[own(s), own(n)] = min((own(u) for u, v, w in pairs if v == n and u in d and d[u] < d[n] == d[u] + w), default=None)
        assert {(r.src, r.node): r.near for r in paths.collect()} == want
        joined = D._with_near(paths.drop("near"), edges)
        assert {(r.src, r.node): r.near for r in joined.collect()} == want


def test_few_routes_in_a_large_network_write_few_rows(spark, monkeypatch):
    """Once a route's end is looked up, the walk writes rows of routes and of the nearest nodes only."""
    n, rows = 6000, []

    def kept(df, name="kept", keep=D.kept):
        df = keep(df, name)
        rows.append(df.count())
        return df

    monkeypatch.setattr(D, "kept", kept)
    monkeypatch.setattr(D, "SENT_ROWS", 60)
    edges = spark.range(1, n).selectExpr("(id - 1) DIV 2 AS u", "id AS v", "0 AS k", "CAST(1 + id % 3 AS DOUBLE) AS length_m")
    nodes = spark.range(n + 1).selectExpr("id AS node_id", "id * 0.001D AS lat", "0D AS lon")
    paths = D.shortest_paths(edges, spark.createDataFrame([(0,), (1,)], "src long"), near=True)
    ends = [5999, 4321, 3000, 17, 2]
    ask = spark.createDataFrame([(s, e) for s in (0, 1) for e in ends] + [(0, n), (1, 1), (0, n + 1)], "origin long, dest long")

    def up(s, e):
        line = [e]
        while line[-1] > s:
            line.append((line[-1] - 1) // 2)
        return line[::-1] if line[-1] == s else [s, e]

    want = {(s, e): up(s, e) for s in (0, 1) for e in ends} | {(0, n): [0, n], (1, 1): [1]}
    for single in (D.SINGLE, 2):
        monkeypatch.setattr(D, "SINGLE", single)
        rows.clear()
        got = {(r.origin, r.dest): [round(p.lat * 1000) for p in r.path] for r in D.route_geometry(ask, paths, edges, nodes).collect()}
        assert got == want
        if single > 2:
            assert sum(rows) < n / 4


def test_streets_with_and_without_lines(spark):
    line = [{"lat": 0.0, "lon": 1.0}, {"lat": 0.5, "lon": 1.5000001}, {"lat": 0.0, "lon": 2.0}]
    edges = spark.createDataFrame([(1, 2, 0, 5.0, line), (1, 2, 1, 9.0, None), (2, 3, 0, 1.0, None), (3, 4, 0, 1.0, [{"lat": 0.1, "lon": 3.0}, {"lat": 0.0, "lon": 4.0}])],
                                  "u long, v long, k int, length_m double, geometry array<struct<lat: double, lon: double>>")
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(6)], "node_id long, lat double, lon double")
    paths = D.shortest_paths(edges, spark.createDataFrame([(1,)], "src long"))
    ask = spark.createDataFrame([(1, 4), (1, 3), (1, 5), (1, 1), (1, 9)], "origin long, dest long")
    got = {r.dest: [(p.lat, p.lon) for p in r.path] for r in D.route_geometry(ask, paths, edges, nodes).collect()}
    assert got == {3: [(0.0, 1.0), (0.5, 1.5), (0.0, 2.0), (0.0, 3.0)], 4: [(0.0, 1.0), (0.5, 1.5), (0.0, 2.0), (0.0, 3.0), (0.1, 3.0), (0.0, 4.0)],
                   5: [(0.0, 1.0), (0.0, 5.0)], 1: [(0.0, 1.0)]}
