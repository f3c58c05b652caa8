"""The whole evidence merge as one plan: timetable in, one record per service out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewait.functions.claims import merge_claims, outcome_from_axes
from tidewait.operators.board import board_summary
from tidewait.operators.evidence import best_reading_per_frame, camera_summary, camera_verdict
from tidewait.operators.intervals import services_with_readings
from tidewait.operators.ledger import departure_ledger, tracked_departures
from tidewait.operators.reports import report_rollup
from tidewait.operators.services import SERVICE_KEY, with_neighbours
from tidewait.params import Params


@dataclass(frozen=True)
class Evidence:
    """The feeds a merge reads.

    terminals(route, terminal, destination, berth_visible, clear_needs_departure,
    full_lanes_at_capacity) carries what each terminal's cameras are entitled to claim.
    """

    readings: DataFrame
    board: DataFrame
    positions: DataFrame
    reports: DataFrame
    terminals: DataFrame


def timed_services(services: DataFrame, evidence: Evidence, params: Params) -> DataFrame:
    """Services with the board's summary, the tracker's departure and the better of the two."""
    board = board_summary(evidence.board, params).select(
        "route", F.col("terminal").alias("origin"), "service_date",
        F.col("hhmm").alias("depart_hhmm"), "deck_space_min", "left_full", "board_departed_at",
        "deck_outcome", "deck_filled_at", "deck_confidence",
    )
    ledger = departure_ledger(evidence.positions, evidence.board, evidence.terminals, params)
    tracked = tracked_departures(services, ledger, params)
    entitled = evidence.terminals.select(
        "route", F.col("terminal").alias("origin"), "berth_visible", "clear_needs_departure",
        "full_lanes_at_capacity",
    )
    joined = (
        services.join(entitled, ["route", "origin"])
        .join(board, SERVICE_KEY, "left")
        .join(tracked, SERVICE_KEY, "left")
    )
    return joined.withColumns(
        {
            "departed_at": F.coalesce("board_departed_at", "tracked_at"),
            "departed_source": F.when(F.col("board_departed_at").isNotNull(), "board").when(
                F.col("tracked_at").isNotNull(), "tracking"
            ),
            "deck_outcome": F.coalesce("deck_outcome", F.lit("unknown")),
        }
    )


def evidence_between(evidence: Evidence, first: date, last: date) -> Evidence:
    """The part of each feed that records of these dates can rest on: the dates and a day either side, which
    covers every window and any zone's offset. The bounds are literals, so scans prune by them."""
    before, after = F.lit(first - timedelta(days=1)), F.lit(last + timedelta(days=1))
    dated = lambda df: df.filter(F.col("service_date").between(before, after))
    timed = lambda df, c: df.filter(
        (F.col(c) >= before.cast("timestamp")) & (F.col(c) < F.lit(last + timedelta(days=2)).cast("timestamp"))
    )
    return Evidence(
        timed(evidence.readings, "captured_at"), dated(evidence.board), timed(evidence.positions, "reported_at"),
        dated(evidence.reports), evidence.terminals,
    )


def service_records(services: DataFrame, evidence: Evidence, params: Params,
                    dates: tuple[date, date] | None = None) -> DataFrame:
    """One record per scheduled service; of these dates, first to last, if they are given.

    A range is pushed into all five feeds, so a refresh of a few days reads a few days. Board, tracker and reports meet the services on
    the service key, each folded to one row per service; the one wide join is readings to windows, keyed by terminal and hour,
    and its fold carries the services along.
    """
    if dates is not None:
        first, last = dates
        evidence = evidence_between(evidence, first, last)
        near = F.col("service_date").between(F.lit(first - timedelta(days=1)), F.lit(last + timedelta(days=1)))
        asked = F.col("service_date").between(F.lit(first), F.lit(last))
        placed = with_neighbours(services.filter(near)).filter(asked)
    else:
        placed = with_neighbours(services)
    timed = timed_services(placed, evidence, params)
    readings = best_reading_per_frame(
        evidence.readings.filter("usable"),
        ["terminal", "camera", "captured_at"], params.model_version,
    )
    # The services go through the camera's join and fold with all that is known of them.
    seen = camera_summary(services_with_readings(timed, readings, params), params, timed.columns)
    joined = (
        seen.join(report_rollup(evidence.reports), SERVICE_KEY, "left")
        .withColumn(
            "departure_seen",
            F.coalesce("left_at", "departed_at").isNotNull() | F.col("deck_space_min").isNotNull(),
        )
    )
    judged = camera_verdict(joined, params)
    claims = merge_claims(
        F.col("camera_outcome"), F.col("camera_cancelled"), F.col("deck_outcome"),
        F.col("left_full"), F.col("reported_outcome"),
    )
    merged = judged.withColumns(claims)
    reported = F.col("reported_outcome").isNotNull()
    by_board = (F.col("camera_outcome") == "unknown") & (
        (F.col("deck_outcome") != "unknown") | F.coalesce(F.col("left_full"), F.lit(False))
    )
    return merged.select(
        *SERVICE_KEY, "destination", "scheduled", "day_type", "season",
        outcome_from_axes(
            F.col("filled"), F.col("left_behind"), F.col("cancelled"), F.col("waited")
        ).alias("outcome"),
        "filled", "left_behind", "cancelled",
        F.coalesce(F.col("left_behind"), F.lit(False)).alias("overload"),
        "peak_queue", "queue_at_departure", "residual_queue", "carryover",
        F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
        F.when(reported, F.col("report_confidence"))
        .when(by_board, F.coalesce("deck_confidence", F.lit(0.7)))
        .otherwise(F.col("camera_confidence")).alias("confidence"),
        F.coalesce("truncated", F.lit(False)).alias("queue_truncated"),
        "deck_space_min",
        F.when(reported, "report").when(by_board, "deck_space")
        .otherwise(F.coalesce("camera_method", F.lit("frames:none"))).alias("method"),
        F.coalesce("deck_filled_at", F.when(F.col("filled"), F.col("fill_mark"))).alias("filled_at"),
        F.col("peak_band"), "band_at_departure", "residual_band", "queue_started_at", "cleared_at",
        "left_full", "departed_at", "departed_source",
    )
