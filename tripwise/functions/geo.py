"""Geometry on (lat, lon) columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwise.functions.numeric import let

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = (p2 - p1) / 2.0, (F.radians(lon2) - F.radians(lon1)) / 2.0
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return F.lit(2.0 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_bbox(lat: Column, lon: Column, bbox) -> Column:
    """Point in (south, west, north, east), inclusive on all sides; a plain range
    test, so it reaches the parquet scan."""
    south, west, north, east = bbox
    return lat.between(south, north) & lon.between(west, east)


def extent(path: Column) -> Column:
    """(south, west, north, east) of a polyline; store it as columns so that
    viewport filters prune row groups."""
    def box(p: Column) -> Column:
        lats, lons = F.transform(p, lambda v: v["lat"]), F.transform(p, lambda v: v["lon"])
        return F.struct(
            F.array_min(lats).alias("south"), F.array_min(lons).alias("west"),
            F.array_max(lats).alias("north"), F.array_max(lons).alias("east"))

    return let(path, box)


def bbox_overlap(ext: Column, bbox) -> Column:
    """Does an extent meet the box?"""
    south, west, north, east = bbox
    return ~((ext["north"] < south) | (ext["south"] > north) | (ext["east"] < west) | (ext["west"] > east))
