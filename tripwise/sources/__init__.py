"""Readers and writers."""

from tripwise.sources.files import (
    POI_COLUMNS, read_personas, read_poi_raw, read_pois, write_personas, write_pois, write_results,
)
from tripwise.sources.graphml import read_network, write_network
from tripwise.sources.trip_store import read_trips, write_trips

__all__ = [name for name in dir() if not name.startswith("_")]
