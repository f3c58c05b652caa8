"""First-hand reports: acceptance, roll-up and what they bound."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.calendar import with_calendar
from tidewait.functions.claims import outcome_of_reports, report_confidence
from tidewait.functions.clock import (
    combine_local,
    hhmm_minutes,
    local_hhmm,
    minutes_floor,
    minutes_hhmm,
    seconds_apart,
    seconds_between,
)
from tidewait.functions.stats import upper_median
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import DECK_FULLNESS, REPORT_SOURCES, Params


def validate_reports(reports: DataFrame, services: DataFrame, terminals: DataFrame,
                     board_departures: DataFrame, params: Params, stored: DataFrame | None = None) -> DataFrame:
    """Add `reason` (first refusal, NULL when accepted) and the departure the report keeps.

    Of the reports that pass every other test, a service takes the first fifty by submission, less
    those already stored for it.
    """
    known = terminals.select("route", F.col("terminal").alias("origin"), F.lit(True).alias("_terminal"))
    timetable = services.select(*SERVICE_KEY, F.lit(True).alias("_scheduled"))
    published = board_departures.select(
        "route", F.col("terminal").alias("origin"), "service_date",
        F.col("hhmm").alias("depart_hhmm"), F.col("departed_at").alias("_board_departed"),
    )
    # Looked up once per service, not per report: a terminal's reports are never brought together.
    places = (
        reports.select(*SERVICE_KEY).distinct()
        .join(known, ["route", "origin"], "left")
        .join(timetable, SERVICE_KEY, "left")
        .join(published, SERVICE_KEY, "left")
        .withColumnsRenamed({k: f"_{k}" for k in SERVICE_KEY})
    )
    # A report that lacks a part of its key has its place as well.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SERVICE_KEY])
    checked = (
        reports.join(places, same, "left").drop(*[f"_{k}" for k in SERVICE_KEY])
        .withColumn("scheduled", combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone))
        .withColumn("kept_departed_at", F.coalesce("departed_at", "_board_departed"))
    )
    last = F.coalesce(F.col("kept_departed_at"), F.col("scheduled"))
    waited = F.col("sailings_waited")
    rules: list[tuple[str, Column]] = [
        ("unknown terminal", F.col("_terminal").isNull()),
        ("not in timetable", F.col("_scheduled").isNull()),
        ("unknown deck fullness",
         F.col("deck_fullness").isNotNull() & ~F.col("deck_fullness").isin("", *DECK_FULLNESS)),
        ("unknown source", ~F.coalesce(F.col("source").isin(*REPORT_SOURCES), F.lit(False))),
        ("not departed yet", F.col("scheduled") > F.col("submitted_at")),
        ("departure too far from schedule",
         seconds_apart(F.col("departed_at"), F.col("scheduled")) > params.max_departure_drift_hours * 3600),
        ("waited while boarded", waited.isNotNull() & F.col("boarded")),
        ("bad wait", ~waited.isin(1, 2)),
        ("joined after departure", F.col("joined_at") > last),
        ("joined too early",
         seconds_between(last, F.col("joined_at")) > params.max_queue_hours * 3600),
    ]
    chain = F.lit(None).cast("string")
    for name, refused in reversed(rules):
        chain = F.when(F.coalesce(refused, F.lit(False)), F.lit(name)).otherwise(chain)
    judged = checked.withColumn("reason", chain)
    # Only reports that passed compete for a service's places. The first fifty are found with
    # a top-k that each task applies before the shuffle, and everything else is over the limit.
    order = W.partitionBy(*SERVICE_KEY).orderBy("submitted_at", "report_id")
    admitted = (
        judged.filter(F.col("reason").isNull())
        .select(*SERVICE_KEY, "submitted_at", "report_id")
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= params.max_reports_per_service)
    )
    if stored is not None:
        taken = stored.groupBy(*SERVICE_KEY).agg(F.count(F.lit(1)).alias("_taken"))
        admitted = admitted.join(taken, SERVICE_KEY, "left").filter(
            F.col("_place") <= params.max_reports_per_service - F.coalesce("_taken", F.lit(0))
        )
    admitted = admitted.select("report_id", F.lit(True).alias("_admitted"))
    return (
        judged.join(admitted, "report_id", "left")
        .withColumn(
            "reason",
            F.coalesce(F.col("reason"), F.when(F.col("_admitted").isNull(), F.lit("service is full"))),
        )
        .drop("_terminal", "_scheduled", "_board_departed", "_admitted")
    )


def report_rollup(reports: DataFrame) -> DataFrame:
    """One row per scheduled service: the outcome its reports support and their weight."""
    missed = ~F.col("boarded")
    rolled = reports.groupBy(*SERVICE_KEY).agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.bool_or(missed).alias("any_missed"),
        F.max(F.when(missed, F.col("sailings_waited"))).alias("longest_wait"),
    )
    return rolled.withColumns(
        {
            "reported_outcome": outcome_of_reports(
                F.col("n_reports"), F.col("any_missed"), F.col("longest_wait")
            ),
            "report_confidence": report_confidence(F.col("n_reports")),
        }
    )


def reports_for_services(services: DataFrame, reports: DataFrame) -> DataFrame:
    """Services with their reports' roll-up, keyed by the schedule."""
    return services.join(report_rollup(reports), SERVICE_KEY, "left")


def reported_departures(reports: DataFrame) -> DataFrame:
    """Upper median reported departure per service, exact to the second."""
    return (
        reports.filter(F.col("departed_at").isNotNull())
        .withColumn("_s", F.unix_seconds("departed_at"))
        .groupBy(*SERVICE_KEY)
        .agg(F.timestamp_seconds(upper_median("_s").cast("long")).alias("reported_departed_at"))
    )


def report_summary(reports: DataFrame, params: Params) -> DataFrame:
    """Per service: counts, the strongest bound each way and the typical lateness."""
    clock = lambda c: local_hhmm(F.col(c), params.zone)
    scheduled = combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone)
    rows = reports.withColumns(
        {
            "_joined": clock("joined_at"),
            "_late": minutes_floor(F.col("departed_at"), scheduled),
        }
    )
    return rows.groupBy(*SERVICE_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("boarded"), 1)).alias("boarded"),
        F.count(F.when(~F.col("boarded"), 1)).alias("left_behind"),
        F.min(F.when(~F.col("boarded"), F.col("_joined"))).alias("cutoff_before"),
        F.max(F.when(F.col("boarded"), F.col("_joined"))).alias("still_room_at"),
        upper_median("_late").cast("int").alias("typical_minutes_late"),
        outcome_of_reports(
            F.count(F.lit(1)), F.bool_or(~F.col("boarded")),
            F.max(F.when(~F.col("boarded"), F.col("sailings_waited"))),
        ).alias("outcome"),
    )


def report_entries(reports: DataFrame, params: Params) -> DataFrame:
    """Each report as it is listed under its service."""
    clock = lambda c: local_hhmm(F.col(c), params.zone)
    scheduled = combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone)
    return reports.select(
        *SERVICE_KEY, "report_id", "boarded", clock("joined_at").alias("joined"),
        clock("departed_at").alias("departed"),
        minutes_floor(F.col("departed_at"), scheduled).alias("minutes_late"),
        F.when(F.col("deck_fullness").isin(*DECK_FULLNESS), F.col("deck_fullness")).alias("fullness"),
        clock("submitted_at").alias("submitted"),
    )


def report_bounds(targets: DataFrame, reports: DataFrame, params: Params) -> DataFrame:
    """What people in line proved about the cutoff on days like each target's.

    targets(route, origin, service_date, depart_hhmm, fill_minutes_before). Pools the same day
    type and long-weekend flag within the tolerance over every other date.

    The reports are folded to one row per (slot, date), then to one per slot with the best two dates for each figure.
    Slots meet the different clock times asked for, not the targets: both are of the timetable's size, and meet in
    buckets of minutes. Each clock time gets the best two dates over all slots near it, so a target, which joins its
    own clock's one row, leaves out its date by taking the other. What its date added to the counts is
    found among the few services of that date.
    """
    leads = with_calendar(
        reports.filter(F.col("joined_at").isNotNull()).withColumn(
            "lead",
            minutes_floor(
                combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone),
                F.col("joined_at"),
            ),
        ).filter(F.col("lead") > 0)
    )
    slot = ["route", "origin", "day_type", "long_weekend", "depart_hhmm"]
    boarded, missed = F.col("boarded"), ~F.col("boarded")
    dates = leads.groupBy(*slot, "service_date").agg(
        F.max(F.when(missed, F.col("lead"))).alias("failed_lead"),
        F.min(F.when(boarded, F.col("lead"))).alias("boarded_lead"),
        F.count(F.when(boarded, 1)).alias("n_boarded"),
        F.count(F.when(missed, 1)).alias("n_missed"),
    )
    # Each slot's two best dates either way; a slot has at most a calendar of them.
    of_slot = W.partitionBy(*slot)
    ranked = dates.withColumns(
        {
            "_f": F.row_number().over(
                of_slot.orderBy(F.col("failed_lead").desc_nulls_last(), F.col("service_date").desc())
            ),
            "_b": F.row_number().over(
                of_slot.orderBy(F.col("boarded_lead").asc_nulls_last(), F.col("service_date"))
            ),
        }
    )

    def placed(rank: str, place: int, lead: str) -> Column:
        return F.max(
            F.when((F.col(rank) == place) & F.col(lead).isNotNull(), F.struct(lead, "service_date"))
        )

    slots = ranked.groupBy(*slot).agg(
        placed("_f", 1, "failed_lead").alias("best_failed"),
        placed("_f", 2, "failed_lead").alias("next_failed"),
        placed("_b", 1, "boarded_lead").alias("best_boarded"),
        placed("_b", 2, "boarded_lead").alias("next_boarded"),
        F.sum("n_boarded").alias("n_boarded"),
        F.sum("n_missed").alias("n_missed"),
        F.count(F.lit(1)).alias("n_dates"),
        F.count(F.when(F.col("n_missed") > 0, 1)).alias("n_missed_dates"),
    ).withColumn("_minutes", hhmm_minutes(F.col("depart_hhmm")))

    like = ["route", "origin", "day_type", "long_weekend"]
    tolerance = params.tolerance_minutes
    width = max(1, tolerance)
    wanted = with_calendar(
        targets.select("route", "origin", "service_date", F.col("depart_hhmm").alias("target_hhmm"), "fill_minutes_before").distinct()
    ).withColumn("target_minutes", hhmm_minutes(F.col("target_hhmm")))
    # Clock times are folded to a set per kind of day before they are shuffled.
    reach = F.sequence(F.expr(f"floor((target_minutes - {tolerance}) / {width})"), F.expr(f"floor((target_minutes + {tolerance}) / {width})"))
    asked = wanted.filter(F.col("target_minutes").isNotNull()).select(*like, "target_hhmm", "target_minutes").distinct()
    met = asked.withColumn("_bucket", F.explode(reach)).join(
        slots.withColumn("_bucket", F.floor(F.col("_minutes") / width)), [*like, "_bucket"]
    ).filter(F.abs(F.col("_minutes") - F.col("target_minutes")) <= tolerance)

    def candidates(best: str, second: str, lead: str) -> Column:
        dated = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)[lead].alias(lead), F.col(c)["service_date"].alias("service_date"), "depart_hhmm"))
        return F.flatten(F.collect_list(F.array_compact(F.array(dated(best), dated(second)))))

    # At most two dates of each slot within the tolerance.
    near = met.groupBy(*like, "target_hhmm").agg(
        F.sort_array(candidates("best_failed", "next_failed", "failed_lead"), asc=False).alias("_failed"),
        F.sort_array(candidates("best_boarded", "next_boarded", "boarded_lead")).alias("_got_on"),
        *[F.sum(c).alias(c) for c in ("n_boarded", "n_missed", "n_dates", "n_missed_dates")],
    )
    # The first of each list, and the first of another date.
    other = lambda c: F.try_element_at(F.filter(c, lambda x: x["service_date"] != F.col(c)[0]["service_date"]), F.lit(1))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    near = near.select(
        *like, "target_hhmm", "n_boarded", "n_missed", "n_dates", "n_missed_dates", first("_failed").alias("failed"), other("_failed").alias("failed_other"),
        first("_got_on").alias("got_on"), other("_got_on").alias("got_on_other"),
    )
    day = ["route", "origin", "service_date"]
    own = wanted.select(*day, "target_hhmm", "target_minutes").distinct().join(
        dates.select(*day, hhmm_minutes(F.col("depart_hhmm")).alias("_minutes"), F.col("n_boarded").alias("_b"), F.col("n_missed").alias("_m")), day
    ).filter(F.abs(F.col("_minutes") - F.col("target_minutes")) <= tolerance).groupBy(*day, "target_hhmm").agg(
        F.sum("_b").alias("own_boarded"), F.sum("_m").alias("own_missed"),
        F.count(F.lit(1)).alias("own_dates"), F.count(F.when(F.col("_m") > 0, 1)).alias("own_missed_dates"),
    )
    met_own = wanted.join(near, [*like, "target_hhmm"]).join(own, [*day, "target_hhmm"], "left")
    mine = lambda c: F.coalesce(F.col(c)["service_date"] == F.col("service_date"), F.lit(False))
    less = lambda total, owned: (F.col(total) - F.coalesce(owned, F.lit(0))).alias(total)
    bounds = met_own.select(
        *day, "target_hhmm", "target_minutes", "fill_minutes_before",
        F.when(mine("failed"), F.col("failed_other")).otherwise(F.col("failed")).alias("strongest"),
        F.when(mine("got_on"), F.col("got_on_other")).otherwise(F.col("got_on"))["boarded_lead"].alias("lowest_boarded"),
        less("n_boarded", "own_boarded"), less("n_missed", "own_missed"),
        less("n_dates", "own_dates").alias("n_sailings"), less("n_missed_dates", "own_missed_dates").alias("turned_away_sailings"),
    )
    lead = F.col("strongest.failed_lead")
    tightens = lead.isNotNull() & (
        F.col("fill_minutes_before").isNull() | (lead > F.col("fill_minutes_before"))
    )
    got_on = F.when(F.col("n_boarded") >= params.min_boarded_reports, F.col("lowest_boarded"))
    return bounds.filter(tightens | got_on.isNotNull()).select(
        "route", "origin", "service_date", F.col("target_hhmm").alias("depart_hhmm"),
        F.when(tightens, minutes_hhmm(F.col("target_minutes") - lead)).alias("turned_away_at"),
        F.when(tightens, lead).alias("turned_away_minutes_before"),
        F.when(tightens, F.col("strongest.service_date")).alias("turned_away_date"),
        "turned_away_sailings",
        minutes_hhmm(F.col("target_minutes") - got_on).alias("boarded_by"),
        got_on.alias("boarded_by_minutes_before"),
        "n_sailings",
        (F.col("n_boarded") + F.col("n_missed")).alias("n_reports"),
    )
