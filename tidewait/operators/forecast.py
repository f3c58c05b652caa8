"""Forecasts in force, and what a wind band has meant so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import local_date, minutes_floor
from tidewait.params import Params


def forecast_in_force(forecasts: DataFrame, keys: list[str], preferred_kind: str, now: Column,
                      params: Params, tiebreak: list[str] | None = None) -> DataFrame:
    """Newest good issue per key; of one issue the preferred kind.

    A plain arg-max per key, so it merges partially before the shuffle.
    """
    rest = [c for c in forecasts.columns if c not in keys]
    rank = F.struct(
        F.col("issued_at"), (F.col("kind") == preferred_kind), *[F.col(c) for c in tiebreak or []]
    )
    chosen = (
        forecasts.filter(F.col("fetch_status") == "ok")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("f"))
        .select(*keys, "f.*")
    )
    hours = F.greatest(F.lit(0), F.floor(minutes_floor(now, F.col("issued_at")) / 60)).cast("int")
    return chosen.withColumn("stale_hours", hours).withColumns(
        {
            "stale": F.col("stale_hours") >= params.stale_forecast_hours,
            "carried_over": F.col("service_date") != local_date(F.col("issued_at"), params.zone),
            "issued_label": issue_label(F.col("stale_hours")),
        }
    )


def issue_label(hours: Column) -> Column:
    return (
        F.when(hours < 1, "issued in the last hour")
        .when(hours < 48, F.format_string("issued %d h ago", hours))
        .otherwise(F.format_string("issued %d days ago", F.floor(hours / 24).cast("int")))
    )


def band_records(forecasts: DataFrame, records: DataFrame, params: Params) -> DataFrame:
    """For each date and band forecast for it: what earlier days in that band led to.

    Folded to one row per (route, band, date) first, so the running totals walk at most the
    calendar. An unreadable band never has a record, and "nothing was cancelled" needs twenty
    days behind it.
    """
    days = (
        forecasts.filter((F.col("fetch_status") == "ok") & (F.col("band") != "unknown"))
        .select("route", "band", "service_date")
        .distinct()
    )
    outcomes = (
        records.filter(F.col("outcome") != "unknown")
        .groupBy("route", "service_date")
        .agg(
            F.count(F.lit(1)).alias("sailings"),
            F.count(F.when(F.col("outcome") == "cancelled", 1)).alias("cancelled"),
        )
    )
    daily = days.join(outcomes, ["route", "service_date"], "left")
    earlier = (
        W.partitionBy("route", "band").orderBy("service_date")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    running = daily.select(
        "route", "band", "service_date",
        F.count(F.lit(1)).over(earlier).alias("days"),
        F.min("service_date").over(earlier).alias("since"),
        F.coalesce(F.sum("sailings").over(earlier), F.lit(0)).alias("sailings"),
        F.coalesce(F.sum("cancelled").over(earlier), F.lit(0)).alias("cancelled"),
    )
    return running.filter(
        (F.col("sailings") > 0)
        & ((F.col("cancelled") > 0) | (F.col("days") >= params.min_band_days))
    )


def precedence_union(regular: DataFrame, extended: DataFrame, keys: list[str]) -> DataFrame:
    """Regular days, and extended days no regular day covers."""
    covered = regular.select(*keys).distinct()
    return regular.unionByName(extended.join(covered, keys, "left_anti"))
