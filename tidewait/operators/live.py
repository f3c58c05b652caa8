"""The day as it stands at one moment: who has gone, who is late, what is next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import add_minutes, local_date, minutes_floor
from tidewait.operators.board import board_state
from tidewait.operators.intervals import newest_per_group
from tidewait.operators.ledger import tracker_watch
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params

DAY = ["route", "origin", "service_date"]
Now = Callable[[Column], Column]


def fresh_within(observed_at: Column, now: Column, minutes: int) -> Column:
    """Whether a feed's latest reading is recent enough to be believed; never NULL."""
    return F.coalesce(observed_at >= add_minutes(now, -minutes), F.lit(False))


def feed_freshness(feed: DataFrame, keys: list[str], at: str, now: Column, minutes: int) -> DataFrame:
    """Latest reading per feed and whether the feed is still worth reading."""
    latest = feed.filter(F.col(at) <= now).groupBy(*keys).agg(F.max(at).alias("latest_at"))
    return latest.withColumn("fresh", fresh_within(F.col("latest_at"), now, minutes))


def holding_resolution(services: DataFrame, board: DataFrame, positions: DataFrame,
                       terminals: DataFrame, now: Now, params: Params) -> DataFrame:
    """Services with `past`, `sailed` and `holding` (due, but not gone).

    A fresh board decides; it can only be corrected toward "gone" by the tracker. Without a
    board a fresh tracker may hold a service; otherwise the clock's answer stands. Any date
    but the one `now` falls on is left to the clock.
    """
    moment = now(F.col("service_date"))
    scrapes = board.filter(F.col("observed_at") <= moment)
    state = board_state(scrapes)
    per_service = state.select(
        "route", F.col("terminal").alias("origin"), "service_date",
        F.col("hhmm").alias("depart_hhmm"), "departed_hhmm", "listed",
    )
    per_day = scrapes.filter(F.col("fetch_status") == "ok").groupBy(
        "route", F.col("terminal").alias("origin"), "service_date"
    ).agg(F.max("observed_at").alias("board_at"))
    watched = (
        tracker_watch(services, positions, board, terminals, now, params)
        .join(per_service, SERVICE_KEY, "left")
        .join(per_day, DAY, "left")
    )
    today = local_date(moment, params.zone) == F.col("service_date")
    board_fresh = today & fresh_within(F.col("board_at"), moment, 2 * params.poll_minutes)
    tracker_fresh = today & fresh_within(F.col("tracker_at"), moment, params.tracker_fresh_minutes)
    tracked = F.when(tracker_fresh, F.col("tracker_state"))
    by_board = (
        F.col("departed_hhmm").isNotNull()
        | ~F.coalesce(F.col("listed"), F.lit(False))
        | F.coalesce(tracked == "departed", F.lit(False))
    )
    gone = F.when(board_fresh, by_board).otherwise(~F.coalesce(tracked == "not_away", F.lit(False)))
    return watched.withColumns(
        {"past": F.col("scheduled") <= moment, "board_fresh": board_fresh, "tracker_fresh": tracker_fresh}
    ).withColumns(
        {"sailed": F.col("past") & gone, "holding": F.col("past") & ~gone}
    )


def _answerable() -> Column:
    return F.col("sufficient") & (F.col("n") > 0)


def worst_of_day(rows: DataFrame, params: Params) -> DataFrame:
    """The one service to avoid per terminal-day, where there is a clear one."""
    day = W.partitionBy(*DAY)
    known = rows.filter(_answerable()).withColumns(
        {
            "_place": F.rank().over(day.orderBy("boarded_share")),
            "_known": F.count(F.lit(1)).over(day),
        }
    )
    first = known.filter(F.col("_place") == 1).groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("ties"), F.max("_known").alias("answerable"),
        F.min("depart_hhmm").alias("worst_hhmm"), F.min("boarded_share").alias("boarded_share"),
    )
    return first.filter(
        (F.col("ties") == 1) & (F.col("answerable") >= 2)
        & (F.col("boarded_share") < params.outlook_tossup)
    ).drop("ties")


def day_shape(rows: DataFrame, params: Params) -> DataFrame:
    """Where the easy and the hard services of a terminal-day sit, as short texts.

    A day needs three answerable services and half its timetable.
    """
    day = W.partitionBy(*DAY).orderBy("depart_hhmm")
    flagged = rows.withColumns(
        {
            "place": F.row_number().over(day),
            "easy": _answerable() & (F.col("boarded_share") >= params.outlook_room),
            "hard": _answerable() & (F.col("boarded_share") < params.outlook_tossup),
        }
    )
    at = F.struct("place", "depart_hhmm")
    edges = flagged.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("services"),
        F.count(F.when(_answerable(), 1)).alias("answerable"),
        F.min_by("easy", "place").alias("first_easy"),
        F.max_by("easy", "place").alias("last_easy"),
        F.min(F.when(~F.col("easy"), at)).alias("first_other"),
        F.max(F.when(~F.col("easy"), at)).alias("last_other"),
        F.array_sort(F.collect_list(F.when(F.col("easy"), F.col("depart_hhmm")))).alias("easy_times"),
    )
    runs = flagged.filter("hard").withColumn(
        "_island",
        F.col("place") - F.row_number().over(W.partitionBy(*DAY).orderBy("place")),
    ).groupBy(*DAY, "_island").agg(
        F.count(F.lit(1)).alias("length"),
        F.min("place").alias("start"),
        F.min("depart_hhmm").alias("first_hhmm"),
        F.max("depart_hhmm").alias("last_hhmm"),
    )
    longest = runs.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max_by(F.struct("length", "first_hhmm", "last_hhmm"), F.struct("length", -F.col("start"))).alias("run"),
    )
    ends = F.array_compact(
        F.array(
            F.when(
                F.col("first_easy") & F.col("first_other").isNotNull(),
                F.concat(F.lit("before "), F.col("first_other.depart_hhmm")),
            ),
            F.when(
                F.col("last_easy") & F.col("last_other").isNotNull(),
                F.concat(F.lit("after "), F.col("last_other.depart_hhmm")),
            ),
        )
    )
    easiest = F.when(F.size(ends) > 0, F.array_join(ends, ", ")).when(
        F.size("easy_times") > 0, F.array_join("easy_times", ", ")
    )
    hardest = F.when(
        F.col("run.length") > 1, F.concat("run.first_hhmm", F.lit("–"), "run.last_hhmm")
    ).when(F.col("runs") == 1, F.col("run.first_hhmm"))
    enough = (F.col("answerable") >= 3) & (F.col("answerable") * 2 >= F.col("services"))
    return edges.filter(enough).join(longest, DAY, "left").select(
        *DAY, "services", "answerable", easiest.alias("easiest"), hardest.alias("hardest")
    )


def live_service_status(rows: DataFrame, held: DataFrame, now: Now, params: Params) -> DataFrame:
    """One state per service: departed, holding, next, worst, last or plain, in that order.

    `rows` is the day board, `held` the result of holding_resolution for the same services.
    """
    marks = held.select(*SERVICE_KEY, "scheduled", "past", "sailed", "holding")
    worst = worst_of_day(rows, params).select(*DAY, "worst_hhmm")
    day = W.partitionBy(*DAY)
    board = rows.join(marks, SERVICE_KEY).join(worst, DAY, "left")
    moment = now(F.col("service_date"))
    today = local_date(moment, params.zone) == F.col("service_date")
    ahead = F.when(F.col("scheduled") >= moment, F.col("scheduled"))
    placed = board.withColumns(
        {
            "_next": F.min(ahead).over(day),
            "_last": F.max("scheduled").over(day),
        }
    )
    status = (
        F.when(F.col("sailed"), "departed")
        .when(F.col("holding"), "holding")
        .when(today & (F.col("scheduled") == F.col("_next")), "next")
        .when(F.col("depart_hhmm") == F.col("worst_hhmm"), "worst")
        .when(F.col("scheduled") == F.col("_last"), "last")
        .otherwise("plain")
    )
    return placed.withColumn("status", status).drop("_next", "_last", "worst_hhmm")


def live_readings(readings: DataFrame, now: Column, params: Params) -> DataFrame:
    """The newest readings of each terminal within the on-demand age, newest first."""
    recent = readings.filter(
        (F.col("version") == params.model_version)
        & F.col("captured_at").between(add_minutes(now, -params.on_demand_age_minutes), now)
    )
    newest = [F.col("captured_at").desc(), F.col("frame_id").desc()]
    return newest_per_group(recent, ["terminal"], newest, params.on_demand_frames).withColumn(
        "age_minutes", F.greatest(F.lit(0), minutes_floor(now, F.col("captured_at")))
    )


def latest_live_reading(readings: DataFrame, now: Column, params: Params) -> DataFrame:
    """Per terminal the newest usable reading in reach, else the newest of any kind."""
    recent = readings.filter(
        (F.col("version") == params.model_version)
        & F.col("captured_at").between(add_minutes(now, -params.on_demand_age_minutes), now)
    ).withColumn("_now", now)
    row = F.struct("frame_id", "captured_at", "vehicle_count", "confidence", "usable", "dock", "beyond", "_now")
    return (
        recent.groupBy("terminal")
        .agg(F.max_by(row, F.struct("usable", "captured_at", "frame_id")).alias("r"))
        .select("terminal", "r.*")
        .withColumn("age_minutes", F.greatest(F.lit(0), minutes_floor(F.col("_now"), F.col("captured_at"))))
        .drop("_now")
    )
