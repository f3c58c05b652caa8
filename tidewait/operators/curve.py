"""How the queue builds before departure on comparable days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import add_minutes, hhmm_minutes, minutes_floor
from tidewait.operators.cohort import partner_day_type
from tidewait.operators.intervals import interval_join
from tidewait.operators.services import SERVICE_KEY, previous_gap_minutes
from tidewait.params import Params

SLOT = ["route", "origin", "day_type", "season", "depart_hhmm"]
SOURCES = ("lanes", "frames", "deck_space")


def _histograms(services: DataFrame, readings: DataFrame, board: DataFrame, params: Params) -> DataFrame:
    """How often each value was read, per slot of history, source and bucket.

    Folding to counts here is what keeps the percentiles cheap: everything after works on
    (slot, bucket, value), whose size does not depend on how many readings there were.
    """
    spans = services.withColumns(
        {
            "terminal": F.col("origin"),
            "window_start": add_minutes(F.col("scheduled"), -params.lookback_minutes),
            "window_end": F.col("scheduled"),
        }
    )
    usable = readings.filter(F.col("usable"))
    met = interval_join(usable, spans, ["terminal"], "captured_at", "window_start", "window_end",
                        salts=params.salts)
    before = minutes_floor(F.col("scheduled"), F.col("captured_at"))
    width = F.lit(params.curve_bucket_minutes)
    lanes = F.when(
        (F.col("version") == params.lane_version) & F.col("lanes_occupied").isNotNull(),
        F.struct(F.lit("lanes").alias("source"), F.col("lanes_occupied").alias("value")),
    )
    counts = F.when(
        F.col("vehicle_count").isNotNull(),
        F.struct(F.lit("frames").alias("source"), F.col("vehicle_count").alias("value")),
    )
    seen = met.withColumn("_before", before).select(
        *SLOT, "_before", F.explode(F.array_compact(F.array(lanes, counts))).alias("m")
    ).select(*SLOT, "_before", "m.source", "m.value")

    stated = board.filter(
        F.col("percent_available").isNotNull() & (F.col("fetch_status") == "ok")
    ).select(
        "route", F.col("terminal").alias("origin"), "service_date",
        F.col("hhmm").alias("depart_hhmm"), "observed_at", "percent_available",
    )
    told = (
        services.join(stated, SERVICE_KEY)
        .withColumn("_before", minutes_floor(F.col("scheduled"), F.col("observed_at")))
        .filter(F.col("_before").between(0, params.lookback_minutes))
        .select(*SLOT, "_before", F.lit("deck_space").alias("source"),
                F.col("percent_available").alias("value"))
    )
    bucket = (F.floor(F.col("_before") / width) * width).cast("int")
    return (
        seen.unionByName(told)
        .groupBy(*SLOT, "source", bucket.alias("bucket"), F.col("value").cast("int").alias("value"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _pool(targets: DataFrame, slots: DataFrame, params: Params) -> DataFrame:
    """Target slots with the slots of history they pool: similar day types, near in time, of
    the same season where that alone is deep enough."""
    asked = targets.select(*SLOT).distinct().withColumn(
        "match_type", F.explode(F.array("day_type", partner_day_type(F.col("day_type"))))
    )
    t = asked.select(
        "route", "origin", F.col("match_type").alias("day_type"),
        F.col("day_type").alias("t_day_type"), F.col("season").alias("t_season"),
        F.col("depart_hhmm").alias("t_hhmm"),
    )
    near = t.join(slots, ["route", "origin", "day_type"]).filter(
        F.abs(hhmm_minutes(F.col("depart_hhmm")) - hhmm_minutes(F.col("t_hhmm")))
        <= params.tolerance_minutes
    )
    key = W.partitionBy("route", "origin", "t_day_type", "t_season", "t_hhmm")
    same = F.col("season") == F.col("t_season")
    deep = F.sum(F.when(same, F.col("services")).otherwise(0)).over(key) >= params.min_sample
    return near.withColumn("_deep", deep).filter(~F.col("_deep") | same).drop("_deep")


TARGET = ["route", "origin", "t_day_type", "t_season", "t_hhmm"]


def arrival_curve(targets: DataFrame, services: DataFrame, readings: DataFrame, board: DataFrame,
                  params: Params) -> DataFrame:
    """Per target slot and bucket: n, median, p25, p75 and max of the best source at hand.

    `services` are past ones with a known outcome, carrying day_type and season. The target's
    date is not left out and the pool has no cap. Percentages drain, so their quartiles swap.
    """
    slots = services.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("services"))
    pool = _pool(targets, slots, params)
    sizes = pool.groupBy(*TARGET).agg(F.sum("services").alias("sailings"))
    cells = (
        pool.join(_histograms(services, readings, board, params), SLOT)
        .groupBy(*TARGET, "source", "bucket", "value")
        .agg(F.sum("times").alias("times"))
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    best = F.min(order).over(W.partitionBy(*TARGET))
    chosen = cells.withColumn("_order", order).withColumn("_best", best).filter(
        F.col("_order") == F.col("_best")
    ).drop("_order", "_best")
    point = [*TARGET, "source", "bucket"]
    group = W.partitionBy(*point)
    upto = group.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = chosen.withColumns({"_upto": F.sum("times").over(upto), "_all": F.sum("times").over(group)})

    def at_rank(fraction: float):
        return F.min(
            F.when(F.col("_upto") > F.bround(F.lit(fraction) * (F.col("_all") - 1)), F.col("value"))
        )

    points = ranked.groupBy(*point).agg(
        F.sum("times").alias("n"), at_rank(0.5).alias("median"), at_rank(0.25).alias("_low"),
        at_rank(0.75).alias("_high"), F.max("value").alias("max"),
    )
    drains = F.col("source") == "deck_space"
    return points.join(sizes, TARGET).select(
        "route", "origin", F.col("t_hhmm").alias("depart_hhmm"), F.col("t_day_type").alias("day_type"),
        F.col("t_season").alias("season"), "sailings", "source",
        F.col("bucket").alias("minutes_before"), "n", "median",
        F.when(drains, F.col("_high")).otherwise(F.col("_low")).alias("p25"),
        F.when(drains, F.col("_low")).otherwise(F.col("_high")).alias("p75"),
        "max",
    )


def previous_departure_offset(targets: DataFrame, services: DataFrame, timetable: DataFrame,
                              params: Params) -> DataFrame:
    """How far before its own time a target's pool saw the previous scheduled departure.

    Stated only when half the pool has one, they agree within a bucket, and it lies inside
    the time a departure goes on mattering.
    """
    gaps = previous_gap_minutes(timetable).select(*SERVICE_KEY, "previous_gap")
    slots = services.join(gaps, SERVICE_KEY, "left").groupBy(*SLOT, "previous_gap").agg(
        F.count(F.lit(1)).alias("services")
    )
    pool = _pool(targets, slots, params)
    folded = pool.groupBy(*TARGET, "previous_gap").agg(F.sum("services").alias("times"))
    known = F.when(F.col("previous_gap").isNotNull(), F.col("times")).otherwise(0)
    group = W.partitionBy(*TARGET)
    upto = group.orderBy(F.col("previous_gap").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = folded.withColumns(
        {"_upto": F.sum(known).over(upto), "_known": F.sum(known).over(group)}
    )
    figures = ranked.groupBy(*TARGET).agg(
        F.sum("times").alias("sailings"),
        F.max("_known").alias("known"),
        F.min("previous_gap").alias("lowest"), F.max("previous_gap").alias("highest"),
        F.min(
            F.when(
                F.col("previous_gap").isNotNull()
                & (F.col("_upto") > F.bround(F.lit(0.5) * (F.col("_known") - 1))),
                F.col("previous_gap"),
            )
        ).alias("middle"),
    )
    horizon = params.lookback_minutes + params.post_window_minutes
    agrees = (
        (F.col("known") > 0) & (F.col("known") * 2 >= F.col("sailings"))
        & (F.col("highest") - F.col("lowest") <= params.curve_bucket_minutes)
        & (F.col("middle") < horizon)
    )
    return figures.select(
        "route", "origin", F.col("t_hhmm").alias("depart_hhmm"), F.col("t_day_type").alias("day_type"),
        F.col("t_season").alias("season"), "sailings",
        F.when(agrees, F.col("middle")).alias("previous_departure_minutes"),
    )
