"""Trajectories: stays, windows, positions, map records.

Moves: run and day columns, agent_id, trip_key, t0, t1, path, mode, purpose.
Times are minutes; days are laid end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import (
    bbox_overlap, cumulative_km, downsample, extent, half_even_round, in_bbox, keyframe_position, let, position_at_fraction,
)
from tripwise.operators.ordering import ordinal, previous

RUN = ["treatment", "seed"]
DAY = RUN + ["day", "agent_id"]


def hour_bucket(t: str = "t0") -> Column:
    return F.floor(F.col(t) / 60)


def moves_from_trips(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Trips with the polyline of their (origin, dest) and its running length; each
    distinct pair is routed once."""
    return with_cumulative(trips.join(routes.select("origin", "dest", "path"), ["origin", "dest"]))


def with_cumulative(moves: DataFrame) -> DataFrame:
    return moves.withColumn("cum", cumulative_km(F.col("path")))


def stays(trips: DataFrame, homes: DataFrame) -> DataFrame:
    """Gaps between the trips of an agent's day.

    The first stay starts at 0 at home; later ones at the previous destination in
    the state of the trip that led there; a gap exists only if the next trip starts
    after the previous one ended.  The last stay to midnight is always there, even
    if the last arrival is later than that.  Trips: DAY, trip_key, t0, t1, lat1,
    lon1, purpose; homes: DAY, lat, lon of everyone present that day.
    """
    order = ["t0", "trip_key"]
    before = F.struct(F.col("t1").alias("t"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), F.col("purpose").alias("state"))
    seen = previous(trips, DAY, order, hour_bucket(), before, "_p").join(homes.withColumnsRenamed({"lat": "_hlat", "lon": "_hlon"}), DAY)
    gaps = seen.select(
        *DAY, F.coalesce("_p.t", F.lit(0).cast("long")).alias("t0"), F.col("t0").alias("t1"), F.coalesce("_p.lat", "_hlat").alias("lat"),
        F.coalesce("_p.lon", "_hlon").alias("lon"), F.coalesce("_p.state", F.lit("home")).alias("state"),
    ).where(F.col("t1") > F.col("t0"))
    last = trips.groupBy(*DAY).agg(F.max_by(before, F.struct(*order)).alias("_p"))
    closing = homes.join(last, DAY, "left").select(
        *DAY, F.coalesce("_p.t", F.lit(0).cast("long")).alias("t0"), F.lit(P.DAY_MINUTES).cast("long").alias("t1"),
        F.coalesce("_p.lat", "lat").alias("lat"), F.coalesce("_p.lon", "lon").alias("lon"), F.coalesce("_p.state", F.lit("home")).alias("state"))
    return gaps.unionByName(closing)


def merge_days(moves: DataFrame) -> DataFrame:
    """Times shifted by the day and a trip id agent-day-index within each run."""
    numbered = ordinal(moves, DAY, ["t0", "trip_key"], hour_bucket(), "_i")
    shift = F.col("day") * P.DAY_MINUTES
    return numbered.withColumns({
        "trip_id": F.concat_ws("-", F.col("agent_id"), F.col("day"), F.col("_i") - 1), "t0": F.col("t0") + shift, "t1": F.col("t1") + shift,
    }).drop("_i")


def merge_day_stays(stays_: DataFrame) -> DataFrame:
    shift = F.col("day") * P.DAY_MINUTES
    return stays_.withColumns({"t0": F.col("t0") + shift, "t1": F.col("t1") + shift})


def trip_lookup(merged: DataFrame, trip_id: str) -> DataFrame:
    return merged.where(F.col("trip_id") == trip_id)


def time_span(moves: DataFrame, stays_: DataFrame) -> DataFrame:
    """Largest time of any move or stay; 0 when there is none."""
    ends = moves.select("t1").unionByName(stays_.select("t1"))
    return ends.agg(F.greatest(F.coalesce(F.max("t1"), F.lit(0)), F.lit(0)).alias("time_span"))


def with_extent(moves: DataFrame) -> DataFrame:
    """Extent as plain columns; stored with the table they let viewport filters skip
    row groups."""
    ext = extent(F.col("path"))
    return moves.withColumn("_e", ext).select(*moves.columns, "_e.*")


def _colour(table: dict, key: Column, default: tuple) -> Column:
    args = []
    for k, rgb in table.items():
        args += [F.lit(k), F.array(*map(F.lit, rgb))]
    return F.coalesce(F.try_element_at(F.create_map(*args), key), F.array(*map(F.lit, default)))


def _stamps(cum: Column) -> Column:
    def times(cs: Column) -> Column:
        total = F.element_at(cs, -1)
        return let(F.when(total == 0, F.lit(1.0)).otherwise(total), lambda total: F.transform(
            cs, lambda c: half_even_round(F.col("t0") + (F.col("t1") - F.col("t0")) * (c / total), 1)))

    return let(cum, times)


def _points(path: Column, digits: int) -> Column:
    return F.transform(path, lambda p: F.struct(half_even_round(p["lat"], digits).alias("lat"), half_even_round(p["lon"], digits).alias("lon")))


def trip_keyframes(moves: DataFrame, points: int | None = None) -> DataFrame:
    """Compact records: rounded points with their times, and a colour; at most
    ``points`` of them where that is asked for, else all."""
    rows = moves.withColumn("_short", downsample(F.col("path"), points) if points else F.col("path"))
    rows = rows.withColumns({"timestamps": _stamps(cumulative_km(F.col("_short"))), "points": _points(F.col("_short"), 5)})
    return rows.withColumn("color", _colour(P.MODE_COLOR, F.col("mode"), (200, 200, 200))).drop("_short")


def trip_geometry(moves: DataFrame) -> DataFrame:
    """Full polyline with a time for every vertex."""
    rows = moves.withColumns({"timestamps": _stamps(cumulative_km(F.col("path"))), "points": _points(F.col("path"), 6)})
    return rows.withColumn("color", _colour(P.MODE_COLOR, F.col("mode"), (200, 200, 200)))


def _overlaps(windows: list[tuple[float, float]]) -> Column:
    """Windows the row's interval meets (closed at both ends), as window numbers."""
    table = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(windows)])
    return F.transform(F.filter(table, lambda x: (F.col("t1") >= x["a"]) & (F.col("t0") <= x["b"])), lambda x: x["w"])


def window_trips(moves: DataFrame, windows: list[tuple[float, float]], bbox=None) -> DataFrame:
    """Moves that meet each window and the box.  Any number of windows is one scan:
    the windows are parameters, so no join takes place.  A table stored with its extent
    (``with_extent``) is filtered while it is read."""
    lo, hi = min(a for a, _ in windows), max(b for _, b in windows)
    rows = moves.where((F.col("t1") >= lo) & (F.col("t0") <= hi))
    if bbox is not None:
        stored = {"south", "west", "north", "east"} <= set(moves.columns)
        own = F.struct("south", "west", "north", "east") if stored else extent(F.col("path"))
        rows = rows.where(bbox_overlap(own, bbox))
    return rows.withColumn("window", F.explode(_overlaps(windows)))


def window_stays(stays_: DataFrame, windows: list[tuple[float, float]], bbox=None) -> DataFrame:
    """Stays that meet each window and the box."""
    lo, hi = min(a for a, _ in windows), max(b for _, b in windows)
    rows = stays_.where((F.col("t1") >= lo) & (F.col("t0") <= hi))
    if bbox is not None:
        rows = rows.where(in_bbox(F.col("lat"), F.col("lon"), bbox))
    rows = rows.withColumn("window", F.explode(_overlaps(windows)))
    return rows.withColumn("color", _colour(P.STATE_COLOR, F.col("state"), (150, 150, 150)))


def interval_join(instants: DataFrame, intervals: DataFrame, keys: list[str], width: int = 60, spread: int = 32) -> DataFrame:
    """Instants (t) inside closed intervals [t0, t1], for tables of instants: both
    sides meet on a time bucket, the exact test runs after it.  Every bucket is dealt to
    ``spread`` tasks by its intervals' own hash, and each gets the bucket's instants; so an hour
    in which all agents travel is no single task's."""
    own = F.pmod(F.xxhash64("t0", "t1", *[c for c in ("agent_id", "trip_key") if c in intervals.columns]), F.lit(spread))
    spans = intervals.withColumns({"_b": F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.greatest(F.col("t1"), F.col("t0")) / width))), "_s": own})
    points = instants.withColumns({"_b": F.floor(F.col("t") / width), "_s": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint")))})
    return points.join(spans, keys + ["_b", "_s"]).where(F.col("t").between(F.col("t0"), F.col("t1"))).drop("_b", "_s")


def positions_at(moves: DataFrame, stays_: DataFrame, instants: list[float] | DataFrame, bbox=None) -> DataFrame:
    """State and place of every agent at each instant: the first move that covers it,
    else the first stay, else no row.

    Instants are a few numbers, or a table of any size with a column ``t``, which then
    meets the intervals on time buckets.  The point is worked out before any shuffle, so
    polylines stay where they are.
    """
    keys = RUN + ["agent_id"]
    if isinstance(instants, DataFrame):
        asked = instants.select(F.col("t").cast("double").alias("t")).where("t is not null").distinct()

        def covering(rows: DataFrame) -> DataFrame:
            return interval_join(asked, rows, [])
    else:
        at = F.array(*[F.lit(float(t)) for t in instants])

        def covering(rows: DataFrame) -> DataFrame:
            return rows.withColumn("t", F.explode(F.filter(at, lambda t: (t >= F.col("t0")) & (t <= F.col("t1")))))

    frac = (F.col("t") - F.col("t0")) / F.greatest(F.lit(1), F.col("t1") - F.col("t0"))
    m = covering(moves).withColumn("_p", position_at_fraction(F.col("path"), cumulative_km(F.col("path")), frac))
    m = m.groupBy(*keys, "t").agg(F.min_by(F.struct("_p.lat", "_p.lon", "mode"), F.struct("t0", "trip_key")).alias("_m"))
    m = m.select(*keys, "t", F.col("_m.lat").alias("lat"), F.col("_m.lon").alias("lon"), F.lit("in_transit").alias("state"), F.col("_m.mode").alias("mode"))
    s = covering(stays_).groupBy(*keys, "t").agg(
        F.min_by(F.struct("lat", "lon", "state"), F.struct("t0", "t1")).alias("_s")).select(*keys, "t", "_s.*")
    s = s.withColumn("mode", F.lit("")).join(m, keys + ["t"], "left_anti")
    rows = m.unionByName(s)
    if bbox is not None:
        rows = rows.where(in_bbox(F.col("lat"), F.col("lon"), bbox))
    return rows.withColumn("color", _colour(P.STATE_COLOR, F.col("state"), (150, 150, 150)))


def keyframe_positions(records: DataFrame, instants: list[float]) -> DataFrame:
    """Positions interpolated in time along the compact records."""
    at = F.array(*[F.lit(float(t)) for t in instants])
    inside = F.filter(at, lambda t: (t >= F.col("timestamps")[0]) & (t <= F.element_at("timestamps", -1)))
    rows = records.withColumn("t", F.explode(inside))
    return rows.withColumn("position", keyframe_position(F.col("points"), F.col("timestamps"), F.col("t")))


def pois_in_bbox(places: DataFrame, bbox=None, after: int | None = None, size: int | None = None) -> DataFrame:
    """All places in the box.  A viewer pages through them in catalog order: ``size``
    places with a position beyond ``after`` (a top-n, never a full sort)."""
    rows = places if bbox is None else places.where(in_bbox(F.col("lat"), F.col("lon"), bbox))
    rows = rows if after is None else rows.where(F.col("pos") > after)
    return rows if size is None else rows.orderBy("pos").limit(size)


def group_by_agent(moves: DataFrame) -> DataFrame:
    """Records collected per run, agent and day, in order; a day bounds their number."""
    keys = RUN + ["agent_id", "day"]
    row = F.struct("t0", "trip_key", *[c for c in moves.columns if c not in (*keys, "t0", "trip_key")])
    return moves.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("trips"))


def poi_labels(places: DataFrame) -> DataFrame:
    """Map rows of places."""
    return places.select(
        half_even_round("lon", 6).alias("lon"), half_even_round("lat", 6).alias("lat"), "category",
        F.concat_ws(" · ", "name", "category").alias("label"), "place_id", "pos")
