"""A vessel's departures of one day, and the end each left from.

On a two-ended route with one vessel departures alternate, so one named departure names its
neighbours. All logic is per (route, ledger date). The feed's unique key (route, vessel,
second) bounds such a group before any window is opened, and a day with two vessels is
dropped first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.claims import is_moving
from tidewait.functions.clock import (
    add_minutes,
    local_date,
    seconds_between,
)
from tidewait.operators.board import published_departures
from tidewait.operators.intervals import interval_join
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params

DAY = ["route", "ledger_date"]


def unique_positions(positions: DataFrame) -> DataFrame:
    """First stored row per (route, vessel, feed time); rows without a feed time all stay.

    NULL times get a key of their own, so they neither merge nor pile up on one task.
    """
    key = ["route", "vessel", "reported_at"]
    rest = [c for c in positions.columns if c not in key]
    own = F.when(
        F.col("vessel").isNull() | F.col("reported_at").isNull(), F.col("row_id")
    )
    return (
        positions.withColumn("_own", own)
        .groupBy(*key, "_own")
        .agg(F.min_by(F.struct(*rest), F.col("row_id")).alias("row"))
        .select(*key, "row.*")
    )


def ledger_days(positions: DataFrame, terminals: DataFrame, params: Params,
                until: Column | None = None) -> DataFrame:
    """Timed readings of two-ended routes with the facts of their ledger date.

    Adds `ledger_date`, `ends` (the route's two terminals), `observed_at`, the day's latest
    feed time, and `alone`, whether one vessel ran. The day windows here and below share one
    shuffle by (route, date).
    """
    timed = positions.filter(F.col("reported_at").isNotNull())
    if until is not None:
        timed = timed.filter(F.col("reported_at") <= until)
    ends = terminals.groupBy("route").agg(F.array_sort(F.collect_set("terminal")).alias("ends"))
    dated = timed.join(ends.filter(F.size("ends") == 2), "route").withColumn(
        "ledger_date", local_date(F.col("reported_at"), params.zone)
    )
    facts = dated.groupBy(*DAY).agg(
        F.max("reported_at").alias("observed_at"),
        F.coalesce(F.min("vessel") == F.max("vessel"), F.lit(True)).alias("alone"),
    )
    return dated.join(facts, DAY)


def transitions(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Stopped-then-moving edges; readings that say nothing are passed over."""
    speaking = positions.withColumn(
        "moving", is_moving(F.col("status"), F.col("speed_knots"))
    ).filter(F.col("moving").isNotNull())
    order = W.partitionBy(*keys).orderBy("reported_at", "row_id")
    edges = speaking.withColumn("was_moving", F.lag("moving").over(order))
    return edges.filter(F.col("moving") & ~F.col("was_moving")).drop("moving", "was_moving")


def day_moments(days: DataFrame) -> DataFrame:
    """Numbered transitions of each single-vessel day."""
    moments = transitions(days.filter(F.col("alone")), DAY).select(
        *DAY, "ends", F.col("reported_at").alias("moment"), "row_id"
    )
    order = W.partitionBy(*DAY).orderBy("moment", "row_id")
    return moments.withColumn("position", F.row_number().over(order))


def anchor_match(moments: DataFrame, board: DataFrame, params: Params) -> DataFrame:
    """Add `anchor`: the terminal of the first published departure within the distance."""
    pad = params.same_departure_minutes
    published = published_departures(board, params).select("route", "terminal", "left_at").distinct()
    spans = moments.withColumns(
        {"_from": add_minutes(F.col("moment"), -pad), "_to": add_minutes(F.col("moment"), pad)}
    )
    met = interval_join(published, spans, ["route"], "left_at", "_from", "_to")
    named = met.groupBy(*DAY, "position").agg(
        F.min_by("terminal", F.struct("left_at", "terminal")).alias("anchor")
    )
    return moments.join(named, [*DAY, "position"], "left")


def ledger_segments(anchored: DataFrame, params: Params) -> DataFrame:
    """Add `segment`: stretches within which alternation can be trusted.

    A cut falls before a step shorter than the least separation, and on both sides of the
    stretch between two consecutive anchors whose parity disagrees.
    """
    day = W.partitionBy(*DAY).orderBy("position")
    behind = day.rowsBetween(W.unboundedPreceding, -1)
    # The next anchor is the last one of the day read backwards: a frame that reaches to the end of a day would be
    # walked again for every row.
    ahead = W.partitionBy(*DAY).orderBy(F.col("position").desc()).rowsBetween(W.unboundedPreceding, -1)
    place = F.struct(F.col("position").alias("p"), F.col("anchor").alias("a"))
    here = F.when(F.col("anchor").isNotNull(), place)
    steps = anchored.withColumn("_next_anchor", F.last(here, ignorenulls=True).over(ahead)).withColumns(
        {
            "_prev_moment": F.lag("moment").over(day),
            "_prev_anchor": F.last(here, ignorenulls=True).over(behind),
        }
    )

    def disagrees(a: Column, pa: Column, b: Column, pb: Column) -> Column:
        return (a == b) != (F.pmod(pb - pa, F.lit(2)) == 0)

    prev, nxt = F.col("_prev_anchor"), F.col("_next_anchor")
    closing = F.col("anchor").isNotNull() & disagrees(
        prev["a"], prev["p"], F.col("anchor"), F.col("position")
    )
    # A row opening the stretch behind an anchor: its predecessor is the anchor itself.
    opening = (prev["p"] == F.col("position") - 1) & F.when(
        F.col("anchor").isNotNull(), closing
    ).otherwise(disagrees(prev["a"], prev["p"], nxt["a"], nxt["p"]))
    short = seconds_between(F.col("moment"), F.col("_prev_moment")) < params.min_separation_minutes * 60
    cut = (
        F.coalesce(short, F.lit(False))
        | F.coalesce(closing, F.lit(False))
        | F.coalesce(opening, F.lit(False))
    )
    return (
        steps.withColumn("cut", cut)
        .withColumn("segment", F.sum(F.col("cut").cast("int")).over(day))
        .drop("_prev_moment", "_prev_anchor", "_next_anchor")
    )


def alternation_labels(segments: DataFrame) -> DataFrame:
    """Add `terminal`: the end each departure left from, NULL where no anchor reaches."""
    stretch = W.partitionBy(*DAY, "segment").orderBy("position")
    whole = stretch.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first_anchor = F.first(
        F.when(
            F.col("anchor").isNotNull(),
            F.struct(F.col("position").alias("p"), F.col("anchor").alias("a")),
        ),
        ignorenulls=True,
    ).over(whole)
    anchored = segments.withColumn("_first", first_anchor)
    index = F.pmod(
        F.array_position("ends", F.col("_first.a")) - 1 + F.col("position") - F.col("_first.p"), F.lit(2)
    )
    return anchored.withColumn(
        "terminal",
        F.when(F.col("_first").isNotNull(), F.element_at("ends", (index + 1).cast("int"))),
    ).drop("_first", "ends")


def departure_ledger(positions: DataFrame, board: DataFrame, terminals: DataFrame,
                     params: Params, until: Column | None = None) -> DataFrame:
    """Every tracked departure with its terminal: route, ledger_date, position, moment, terminal."""
    days = ledger_days(positions, terminals, params, until)
    anchored = anchor_match(day_moments(days), board, params)
    return alternation_labels(ledger_segments(anchored, params))


def pair_departures(services: DataFrame, departures: DataFrame, params: Params) -> DataFrame:
    """(service, tracked_at): the earliest unused departure in reach, handed out in time order.

    departures(route, origin, service_date, left_at); services without one have no row. The hand-out is ordered and exclusive,
    so each terminal-day is walked once as a pair of sorted arrays; both are bounded, by the
    timetable and by the seconds of a day. Slots are walked in order of their reach, so what was left behind a taken departure
    lies before the reach of every later slot: the last one taken is all the walk must remember.
    """
    day = ["route", "origin", "service_date"]
    lists = departures.groupBy(*day).agg(
        F.array_sort(F.collect_set("left_at")).alias("free")
    )
    slots = services.groupBy(*day).agg(
        F.array_sort(
            F.collect_list(F.struct("scheduled", "depart_hhmm"))
        ).alias("slots")
    )
    grace, late = params.grace_minutes, params.late_tolerance_minutes

    def hand_out(state: Column, slot: Column) -> Column:
        reach = F.filter(
            F.col("free"),
            lambda t: (t >= add_minutes(slot["scheduled"], -grace))
            & (t <= add_minutes(slot["scheduled"], late))
            & (state["last"].isNull() | (t > state["last"])),
        )
        took = F.try_element_at(reach, F.lit(1))
        return F.struct(
            F.coalesce(took, state["last"]).alias("last"),
            F.concat(
                state["taken"],
                F.array(F.struct(slot["depart_hhmm"].alias("depart_hhmm"), took.alias("tracked_at"))),
            ).alias("taken"),
        )

    empty = F.struct(
        F.lit(None).cast("timestamp").alias("last"),
        F.array().cast("array<struct<depart_hhmm:string,tracked_at:timestamp>>").alias("taken"),
    )
    walked = slots.join(lists, day).select(
        *day, F.explode(F.aggregate("slots", empty, hand_out)["taken"]).alias("handed")
    )
    return walked.select(*day, "handed.depart_hhmm", "handed.tracked_at").filter(
        F.col("tracked_at").isNotNull()
    )


def tracked_departures(services: DataFrame, ledger: DataFrame, params: Params) -> DataFrame:
    """(service, tracked_at) for the services the tracker saw leave."""
    named = ledger.filter(F.col("terminal").isNotNull()).select(
        "route", F.col("terminal").alias("origin"),
        F.col("ledger_date").alias("service_date"), F.col("moment").alias("left_at"),
    )
    return pair_departures(services, named, params)


def tracker_watch(services: DataFrame, positions: DataFrame, board: DataFrame,
                  terminals: DataFrame, now: Callable[[Column], Column], params: Params) -> DataFrame:
    """At `now`: each service `departed`, `not_away` or NULL when the tracker abstains.

    `now` maps a local date column to the instant that date is looked at; one fixed instant
    for a live board. `tracker_at` is the day's latest feed time. A service not yet due says
    nothing, and neither does a day whose departures could not be given an end.
    """
    seen_on = local_date(F.col("reported_at"), params.zone)
    known = positions.filter(F.col("reported_at") <= now(seen_on))
    days = ledger_days(known, terminals, params)
    facts = days.groupBy(*DAY).agg(F.max("observed_at").alias("tracker_at"))
    ledger = departure_ledger(known, board, terminals, params)
    spoken = ledger.groupBy(*DAY).agg((F.count("terminal") == 0).alias("nameless"))
    day = facts.join(spoken, DAY, "left").withColumnRenamed("ledger_date", "service_date")
    paired = services.join(
        tracked_departures(services, ledger, params), SERVICE_KEY, "left"
    ).join(day, ["route", "service_date"], "left")
    moment = now(F.col("service_date"))
    open_until = add_minutes(F.col("scheduled"), params.late_tolerance_minutes)
    speaks = F.col("tracker_at").isNotNull() & ~F.coalesce(F.col("nameless"), F.lit(False))
    state = F.when(
        (F.col("scheduled") <= moment) & speaks,
        F.when(F.col("tracked_at") <= moment, "departed").when(moment <= open_until, "not_away"),
    )
    return paired.withColumn("tracker_state", state).drop("nameless")
