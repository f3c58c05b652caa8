"""The morning-of answer: how it looks now, and how days like this go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewait.functions.clock import add_minutes, local_date, minutes_floor
from tidewait.operators.cohort import distribution
from tidewait.operators.reports import report_bounds
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params


def check_and_compare(services: DataFrame, readings: DataFrame, records: DataFrame, reports: DataFrame,
                      now: Callable[[Column], Column], params: Params) -> DataFrame:
    """The next service of each terminal-day with its live reading, history and bounds.

    `now` maps a local date to the instant that date is looked at.
    """
    moment = now(F.col("service_date"))
    following = (
        services.filter(F.col("scheduled") >= moment)
        .groupBy("route", "origin", "service_date")
        .agg(F.min_by("depart_hhmm", "scheduled").alias("depart_hhmm"))
    )
    history = distribution(following, records, params).drop("matches")
    bounds = report_bounds(
        history.select(*SERVICE_KEY, "fill_minutes_before"), reports, params
    ).drop("turned_away_sailings", "n_sailings", "n_reports")
    day = local_date(F.col("captured_at"), params.zone)
    seen = readings.filter(F.col("version") == params.model_version).withColumn("_now", now(day))
    recent = seen.filter(
        F.col("captured_at").between(add_minutes(F.col("_now"), -params.on_demand_age_minutes), F.col("_now"))
    )
    row = F.struct(
        "frame_id", "vehicle_count", "confidence", "usable", "dock", "beyond",
        minutes_floor(F.col("_now"), F.col("captured_at")).alias("age_minutes"),
    )
    latest = (
        recent.groupBy(F.col("terminal").alias("origin"), day.alias("service_date"))
        .agg(F.max_by(row, F.struct("usable", "captured_at", "frame_id")).alias("r"))
        .select("origin", "service_date", "r.*")
    )
    return history.join(bounds, SERVICE_KEY, "left").join(latest, ["origin", "service_date"], "left")
