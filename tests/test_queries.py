"""Registered queries against their comparison SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "table1", "table2", "headline", "compare_all", "regret_proxy", "threshold_frontier", "tick_series", "day_summary", "in_bbox",
    "softmax_by_group", "normalize_tokens", "normal_cdf", "classify_poi", "load_catalog", "persona_to_agent", "apply_survey_profile",
    "behavior_overlay", "interest_keywords", "relocate_personas", "rank_prominence", "rank_popularity", "rank_oracle", "best_across_sources",
    "welfare_gate", "abstention", "place_affinity", "keyword_affinity", "travel_cost_state", "match_feedback_trip", "apply_feedback",
    "mode_outcome", "dispatch_paradigm", "subtype_options", "subtype_choice", "stays", "positions_at", "window_trips", "trip_keyframes",
    "nearest_node", "shortest_paths", "nearest_edge", "split_edges", "read_network", "trips_sink", "stream_affinity", "stream_travel_cost",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"treatment", "mean_utility", "sigma_u", "neg_rate", "abstention_rate", "gini", "n_leisure_trips"} and df.count() == 3


def test_every_comparison_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
