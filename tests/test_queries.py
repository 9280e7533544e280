"""Every registered query equals its SQL on the smallest tables, and the contract's functions agree."""
import pytest

import __spark_entry__ as entry
from oracle import DATA, compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, "0.001", QUERIES, ORACLE) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "kept_frames", "decimated_frames"]
    assert set(ORACLE) <= set(QUERIES)


# Queries whose scans, as-of joins or folds run by user or by runs of 500 events
SPLIT = ["presentation_order", "seek_key_packet", "unreferenced_pictures", "field_timeline", "frame_interval_rolling",
         "frame_interval_stats", "project_clock", "clock_jumps", "select_frames", "select_arrived_frames", "missing_frame_waits",
         "refresh_overlap", "pair_layers", "align_layers", "carry_metadata", "normalize_trace", "ring_capacity", "play_sessions",
         "counter_deltas", "in_flight", "select_track", "wait_spans"]


@pytest.mark.parametrize("name", SPLIT)
def test_query_equals_its_sql_when_keys_are_split(spark, name):
    from reelspark.plans import skew
    spark.conf.set(skew.HOT_ROWS_SETTING, "50")
    try:
        assert compare(spark, connect("0.01"), name, "0.01", QUERIES, ORACLE) is None
    finally:
        spark.conf.unset(skew.HOT_ROWS_SETTING)


@pytest.mark.parametrize("name", ["frame_interval", "refresh_interval", "reconcile_timeline", "pair_layers_crowded", "quarantine"])
def test_folds_are_the_same_when_keys_are_split(spark, name):
    from reelspark.plans import skew
    run = lambda: sorted(map(str, QUERIES[name](spark, f"{DATA}/sf0.001").collect()))
    whole = run()
    spark.conf.set(skew.HOT_ROWS_SETTING, "30")
    try:
        assert run() == whole and whole
    finally:
        spark.conf.unset(skew.HOT_ROWS_SETTING)
