"""Which past services are worth reading next, and what that would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.calendar import with_calendar
from tidewait.functions.clock import hhmm_minutes
from tidewait.operators.intervals import nearest_frames, readable_frames, without_reading
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params

SLOT = ["route", "origin", "day_type", "season", "depart_hhmm"]


def fillable_services(targets: DataFrame, services: DataFrame, records: DataFrame, today: Column,
                      params: Params, limit: int = 6) -> DataFrame:
    """Per target slot the newest comparable past services without a known outcome.

    Each slot of history is cut to its own newest `limit` first; no target can use more.
    """
    known = records.filter(F.col("outcome") != "unknown").select(*SERVICE_KEY)
    open_services = with_calendar(services.filter(F.col("service_date") < today)).join(
        known, SERVICE_KEY, "left_anti"
    )
    newest = [F.col("scheduled").desc(), F.col("depart_hhmm").desc()]
    few = open_services.select(*SLOT, "service_date", "scheduled").withColumn(
        "_r", F.row_number().over(W.partitionBy(*SLOT).orderBy(*newest))
    ).filter(F.col("_r") <= limit).drop("_r")
    asked = with_calendar(targets.select(*SERVICE_KEY).distinct()).select(
        "route", "origin", "day_type", "season", F.col("depart_hhmm").alias("target_hhmm")
    ).distinct()
    near = asked.join(few, ["route", "origin", "day_type", "season"]).filter(
        F.abs(hhmm_minutes(F.col("depart_hhmm")) - hhmm_minutes(F.col("target_hhmm")))
        <= params.tolerance_minutes
    )
    per_target = W.partitionBy("route", "origin", "day_type", "season", "target_hhmm").orderBy(*newest)
    return near.withColumn("place", F.row_number().over(per_target)).filter(F.col("place") <= limit)


def unread_frame_counts(services: DataFrame, frames: DataFrame, readings: DataFrame,
                        params: Params) -> DataFrame:
    """Distinct unread essential frames of each service."""
    unread = without_reading(readable_frames(frames), readings, params.model_version)
    return nearest_frames(services, unread, params).groupBy(*SERVICE_KEY).agg(
        F.countDistinct("frame_id").alias("frames")
    )


def fill_offers(answers: DataFrame, fillable: DataFrame, counts: DataFrame, params: Params) -> DataFrame:
    """What filling each target would buy; no row where it would buy nothing.

    answers are the targets' distributions with `n`, `sufficient` and `matches`. A sufficient
    answer is only worth refreshing when a newer service is still unread.
    """
    offered = fillable.join(counts.filter(F.col("frames") > 0), SERVICE_KEY).groupBy(
        "route", "origin", "day_type", "season", F.col("target_hhmm").alias("depart_hhmm")
    ).agg(
        F.count(F.lit(1)).alias("sailings"), F.sum("frames").alias("frames"),
        F.max("service_date").alias("newest_open"),
    )
    newest_sample = F.array_max(F.transform("matches", lambda m: m["service_date"]))
    joined = answers.withColumn("newest_sample", newest_sample).join(offered, SLOT)
    newer = F.coalesce(F.col("newest_open") > F.col("newest_sample"), F.lit(True))
    per_frame = (
        params.typical_input_tokens * params.usd_per_m_input
        + params.typical_output_tokens * params.usd_per_m_output
    ) / 1e6
    return joined.filter(~F.col("sufficient") | newer).select(
        *SERVICE_KEY, "sailings", "frames", F.round(F.col("frames") * per_frame, 4).alias("cost_usd"),
        F.when(F.col("sufficient"), "newer").otherwise("thin").alias("reason"),
        (F.col("n") > 0).alias("has_history"),
    )
