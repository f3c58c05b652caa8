"""Camera evidence per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.claims import (
    band_of_rank,
    band_rank,
    classify_bands,
    classify_counts,
    occupied,
)
from tidewait.functions.clock import add_minutes
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params


def best_reading_per_frame(readings: DataFrame, keys: list[str], model_version: str) -> DataFrame:
    """One reading per frame: any geometric version beats the model's."""
    rest = [c for c in readings.columns if c not in keys]
    preference = F.struct(F.col("version") != model_version, F.col("version"), F.col("frame_id"))
    return (
        readings.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), preference).alias("best"))
        .select(*keys, "best.*")
    )


def peak_band(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The fullest band per group, unknown labels ignored."""
    return readings.groupBy(*keys).agg(
        band_of_rank(F.max(band_rank(F.col("band")))).alias("peak_band")
    )


def camera_departure(pairs: DataFrame, params: Params) -> DataFrame:
    """Add left_at and still_at_dock as the berth shows them.

    A service's window holds at most one row per camera and second, so its group is small
    enough to window over.
    """
    ts, service = F.col("captured_at"), W.partitionBy(*SERVICE_KEY)
    in_grace = ts >= add_minutes(F.col("scheduled"), -params.grace_minutes)
    last_dock = F.max(F.when(in_grace & F.col("dock"), ts)).over(service)
    seen = pairs.withColumn("_last_dock", last_dock)
    gone = F.min(F.when(ts > F.col("_last_dock"), ts)).over(service)
    return seen.withColumn("camera_left_at", gone).withColumn(
        "camera_still", F.col("_last_dock").isNotNull() & F.col("camera_left_at").isNull()
    ).drop("_last_dock")


def _ordered(*extra: Column) -> Column:
    return F.struct(F.col("captured_at"), F.col("frame_id"), *extra)


def camera_summary(pairs: DataFrame, params: Params, carry: list[str] | None = None) -> DataFrame:
    """Everything the camera says about a service, one row each.

    `pairs` are the service's readings with `departed_at` (board or tracker, NULL when
    neither timed it) on every row; a row whose reading is NULL keeps a service without readings. `carry` names further columns of the
    service, equal on all its rows, that the fold takes along.
    """
    taken = [c for c in carry or [] if c not in (*SERVICE_KEY, "scheduled")]
    ts, count, band = F.col("captured_at"), F.col("vehicle_count"), F.col("band")
    dep, departed = F.col("scheduled"), F.col("departed_at")
    scheduled_settle = add_minutes(dep, params.settle_minutes)
    timed = camera_departure(pairs, params)
    settled = timed.withColumns(
        {
            "left_at": F.coalesce(departed, F.col("camera_left_at")),
            "still_at_dock": departed.isNull() & F.col("camera_still"),
            "settle_from": F.greatest(
                scheduled_settle, F.coalesce(departed, F.col("camera_left_at"))
            ),
            "is_occupied": occupied(band, count),
        }
    )
    service = W.partitionBy(*SERVICE_KEY)
    marked = settled.withColumn(
        "last_occupied",
        F.max(F.when(F.col("is_occupied") & (ts <= F.col("settle_from")), ts)).over(service),
    )
    before = ts <= dep
    grace = ts >= add_minutes(dep, -params.grace_minutes)
    after = ts >= F.col("settle_from")
    upto_settle = grace & (ts <= F.col("settle_from"))
    counted, banded = count.isNotNull(), band.isNotNull()
    known_version = F.when(F.col("version") != "", F.col("version"))
    first = lambda value, when: F.min_by(value, F.when(when, _ordered()))
    last = lambda value, when: F.max_by(value, F.when(when, _ordered()))
    at_capacity = (
        (F.col("version") == params.extent_version) & (band == "heavy")
    ) | (
        (F.col("version") == params.lane_version) & (band == "overflowing")
        & F.col("full_lanes_at_capacity")
    )
    return marked.groupBy(*SERVICE_KEY, "scheduled").agg(
        *[F.first(c).alias(c) for c in taken],
        F.count("captured_at").alias("n_frames"),
        F.first("left_at").alias("left_at"),
        F.first("still_at_dock").alias("still_at_dock"),
        F.max(F.when(before & counted, count)).alias("peak_queue"),
        band_of_rank(F.max(F.when(before, band_rank(band)))).alias("peak_band"),
        last(count, before & grace & counted).alias("queue_at_departure"),
        last(band, before & grace & banded).alias("band_at_departure"),
        first(count, after & counted).alias("residual_queue"),
        first(band, after & banded).alias("residual_band"),
        last(band, upto_settle & banded).alias("band_when_left"),
        F.coalesce(F.bool_or(F.when(before & counted, F.col("beyond"))), F.lit(False)).alias("truncated"),
        F.min(F.when(before & F.col("is_occupied"), ts)).alias("queue_started_at"),
        F.min(F.when((ts > F.col("last_occupied")) & ~F.col("is_occupied"), ts)).alias("cleared_at"),
        F.min(F.when(before & at_capacity, ts)).alias("fill_mark"),
        F.count(F.when((before | after) & banded, 1)).alias("n_banded"),
        _used(before, after, banded).alias("used_bands"),
        _used(before, after, counted).alias("used_counts"),
        F.collect_set(F.when((before | after) & banded, known_version)).alias("band_sources"),
        F.collect_set(F.when((before | after) & counted, known_version)).alias("count_sources"),
    )


def _used(before: Column, after: Column, stated: Column) -> Column:
    """Sum and number of confidences of the readings a verdict rests on.

    Summed as whole millionths, so the mean does not depend on the order tasks finish in. A
    reading is never both before departure and after the settle point, which lies later.
    """
    used = (before | after) & stated
    millionths = F.round(F.coalesce(F.col("confidence"), F.lit(0.0)) * 1e6).cast("bigint")
    return F.struct(
        F.sum(F.when(used, millionths)).alias("total"),
        F.count(F.when(used, 1)).alias("n"),
    )


def mean_confidence(used: Column) -> Column:
    """Mean to three places, halves up, by whole-number arithmetic."""
    n, total = used["n"], used["total"]
    return F.when(n > 0, F.floor((2 * total + 1000 * n) / (2000 * n)) / 1000)


def camera_verdict(summary: DataFrame, params: Params) -> DataFrame:
    """Add camera_outcome, camera_cancelled, carryover, camera_confidence, camera_method.

    Needs departure_seen, berth_visible and clear_needs_departure. Services without any
    reading have NULL summary columns and come out `unknown`.
    """
    seen = F.coalesce(F.col("departure_seen"), F.lit(False))
    still = F.coalesce(F.col("still_at_dock"), F.lit(False))
    berth = F.coalesce(F.col("berth_visible"), F.lit(False))
    by_band = classify_bands(
        F.col("residual_band"), F.col("band_at_departure"), seen, still, berth,
        F.coalesce(F.col("band_when_left") == "empty", F.lit(False)),
        F.coalesce(F.col("clear_needs_departure"), F.lit(False)),
    ).struct()
    by_count = classify_counts(
        F.col("residual_queue"), F.col("queue_at_departure"), seen, still, berth,
        params.vessel_capacity, params.residual_threshold,
    ).struct()
    banded = F.coalesce(F.col("n_banded"), F.lit(0)) > 0
    used = F.when(banded, F.col("used_bands")).otherwise(F.col("used_counts"))
    sources = F.when(banded, F.col("band_sources")).otherwise(F.col("count_sources"))
    joined = F.array_join(F.array_sort(sources), "+")
    return summary.withColumns(
        {
            "_verdict": F.when(banded, by_band).otherwise(by_count),
            "camera_confidence": mean_confidence(used),
            "camera_method": F.concat(
                F.lit("frames:"), F.when(F.size(sources) > 0, joined).otherwise("none")
            ),
        }
    ).withColumns(
        {
            "camera_outcome": F.col("_verdict.outcome"),
            "camera_cancelled": F.col("_verdict.cancelled"),
            "carryover": F.col("_verdict.carryover"),
        }
    ).drop("_verdict")
