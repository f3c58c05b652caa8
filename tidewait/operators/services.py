"""From dated timetable blocks to scheduled services, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.calendar import with_calendar
from tidewait.functions.clock import combine_local, local_hhmm, local_time, minutes_floor
from tidewait.params import Params

SERVICE_KEY = ["route", "origin", "service_date", "depart_hhmm"]


def expand_timetable(dates: DataFrame, blocks: DataFrame, terminals: DataFrame,
                     params: Params) -> DataFrame:
    """One row per scheduled service on each of `dates`.

    dates(service_date); blocks(block_no, terminal, route, effective_from, effective_to,
    days array<int> Monday=0, departures array<string>); terminals(route, terminal,
    destination). A block without a route serves every route of its terminal; of two blocks
    naming one departure the earlier block wins. Each block is unrolled over its own dates, so
    the match with `dates` is an equality join and stays one at any number of blocks.
    """
    unrolled = (
        blocks.filter(F.col("effective_from") <= F.col("effective_to"))
        .select(
            "block_no", "terminal", F.col("route").alias("block_route"), "days", "departures",
            F.explode(F.sequence("effective_from", "effective_to")).alias("service_date"),
        )
        .filter(F.array_contains("days", F.weekday("service_date")))
    )
    matched = (
        unrolled.join(dates.select("service_date").distinct(), "service_date")
        .join(terminals.filter(F.col("destination").isNotNull()), "terminal")
        .filter(F.col("block_route").isNull() | (F.col("block_route") == F.col("route")))
        .select(
            "route", F.col("terminal").alias("origin"), "destination", "service_date",
            F.explode("departures").alias("depart_hhmm"), "block_no",
        )
    )
    services = matched.groupBy("route", "origin", "service_date", "depart_hhmm").agg(
        F.min_by("destination", "block_no").alias("destination"),
        F.min("block_no").alias("block_no"),
    )
    return with_calendar(services).withColumn(
        "scheduled", combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone)
    )


def with_neighbours(services: DataFrame) -> DataFrame:
    """Previous and next scheduled departure of the origin on the same date."""
    day = W.partitionBy("route", "origin", "service_date").orderBy("scheduled")
    return services.withColumns(
        {
            "previous_departure": F.lag("scheduled").over(day),
            "next_departure": F.lead("scheduled").over(day),
        }
    )


def upcoming_services(services: DataFrame, now: Column, limit: int, params: Params,
                      per: list[str] | None = None) -> DataFrame:
    """The first `limit` services at or after `now`, over the eight dates from today.

    With `per`, the first `limit` of each group at once.
    """
    today = F.to_date(local_time(now, params.zone))
    due = services.filter(
        F.col("service_date").between(today, F.date_add(today, 7)) & (F.col("scheduled") >= now)
    )
    order = ["scheduled", "origin"]
    if per is None:
        return due.orderBy(*order).limit(limit)
    rank = F.row_number().over(W.partitionBy(*per).orderBy(*order))
    return due.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def service_times(services: DataFrame, now: Column, params: Params) -> DataFrame:
    """Times of each terminal's day in order, and the one to answer about by default."""
    here = local_time(now, params.zone)
    clock, today = local_hhmm(now, params.zone), F.to_date(here)
    days = services.groupBy("route", "origin", "service_date").agg(
        F.array_sort(F.collect_set("depart_hhmm")).alias("times")
    )
    ahead = F.filter("times", lambda t: t >= clock)
    default = F.when(
        F.col("service_date") == today,
        F.coalesce(F.try_element_at(ahead, F.lit(1)), F.element_at("times", -1)),
    ).otherwise(F.element_at("times", 1))
    return days.withColumn("default_hhmm", default)


def expected_times(services: DataFrame, days: DataFrame) -> DataFrame:
    """Times a board could plausibly show on each of `days`: the day before, it and the next."""
    shown = services.select(
        "route", "origin", "depart_hhmm",
        F.explode(
            F.array(*[F.date_add("service_date", o) for o in (-1, 0, 1)])
        ).alias("shown_on"),
    ).distinct()
    return shown.join(days.select(F.col("service_date").alias("shown_on")).distinct(), "shown_on")


def previous_gap_minutes(services: DataFrame) -> DataFrame:
    """Minutes since the previous scheduled departure of the same origin and date."""
    day = W.partitionBy("route", "origin", "service_date").orderBy("scheduled")
    return services.withColumn(
        "previous_gap", minutes_floor(F.col("scheduled"), F.lag("scheduled").over(day))
    )
