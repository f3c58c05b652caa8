"""Shapes of the plans that matter at scale, with broadcasting switched off."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "joi02_readings_in_window", "joi03_nearest_frame_per_offset", "agg14_service_record", "qry06_day_board",
    "qry08_report_bounds", "qry07_arrival_curve", "pix09_read_lane_frames", "str07_budget_stop",
)


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_every_join_has_a_key(shuffled, name):
    text = plan(shuffled, name)
    assert not any(word in text for word in ("NestedLoop", "Cartesian", "BroadcastExchange", "SinglePartition"))


def test_history_is_cut_before_it_is_shuffled(shuffled):
    # Each per-date and per-slot cut is applied by the tasks that write the shuffle, and again after.
    cuts = [x for x in plan(shuffled, "qry06_day_board").splitlines() if "WindowGroupLimit" in x]
    assert cuts and sum("Partial" in x for x in cuts) == sum("Final" in x for x in cuts) == len(cuts) / 2


def scans(spark, name: str) -> list[tuple[set[str], str]]:
    """Columns and pushed filters of every file scan of a query's plan."""
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    found = re.findall(r"FileScan parquet.*?PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>(?:\s|$)", text)
    return [({c.split(":")[0] for c in schema.split(",") if ":" in c}, pushed) for pushed, schema in found]


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("scl04_day_type", {"o_orderkey", "o_orderdate"}),
        ("prj09_request_classification", {"page_id", "url"}),
        ("str04_feed_freshness", {"event_type", "ts"}),
        ("src06_newest_document_per_site", {"page_id", "url"}),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    found = scans(spark, name)
    assert found and set.union(*(c for c, _ in found)) <= columns


def test_filters_reach_the_scan(spark):
    found = scans(spark, "str04_feed_freshness")
    assert found and all("ts" in pushed for _, pushed in found)


def test_pixels_are_never_rows(spark):
    for name in ("pix02_hourly_background", "pix09_read_lane_frames", "pix10_read_extent_frames"):
        text = plan(spark, name).split("posexplode(background")[-1]
        assert "posexplode(pixels" not in text and "explode(pixels" not in text


def exchanges(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", text))


def test_page_texts_are_never_shuffled(spark):
    text = plan(spark, "scl15_board_text_extraction")
    moved = [x for x in text.splitlines() if re.search(r"(?<!Broadcast)Exchange ", x)]
    assert len(moved) == 1 and "hashpartitioning(terminal" in moved[0] and "Window" not in text


def test_the_merge_folds_services_once(spark):
    text = plan(spark, "agg14_service_record")
    assert exchanges(text) <= 28 and text.count("FileScan") <= 14


def test_report_bounds_never_join_targets_to_slots(shuffled):
    # Only clock times, each a row per kind of day, meet slots: the join's key has a bucket of minutes in it.
    text = plan(shuffled, "qry08_report_bounds")
    coarse = [x for x in text.splitlines() if "Join" in x and "long_weekend" in x]
    assert coarse and all("_bucket" in x or "target_hhmm" in x for x in coarse)
