"""What a published board says about each service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.claims import row_departed, says_full
from tidewait.functions.clock import add_minutes, combine_local, midnight_roll, seconds_between
from tidewait.params import Params

BOARD_KEY = ["route", "terminal", "service_date", "hhmm"]


def board_departure_of(rows: DataFrame, params: Params) -> Column:
    return midnight_roll(
        combine_local(F.col("service_date"), F.col("departed_hhmm"), params.zone),
        combine_local(F.col("service_date"), F.col("hhmm"), params.zone),
    )


def board_minimum(board: DataFrame) -> DataFrame:
    """Lowest percentage per service, whatever its fetch status."""
    return board.filter(F.col("percent_available").isNotNull()).groupBy(*BOARD_KEY).agg(
        F.min("percent_available").alias("deck_space_min")
    )


def board_departures(board: DataFrame, params: Params) -> DataFrame:
    """Latest published departure per service, rolled over midnight."""
    latest = (
        board.filter((F.col("fetch_status") == "ok") & F.col("departed_hhmm").isNotNull())
        .groupBy(*BOARD_KEY)
        .agg(F.max_by("departed_hhmm", F.struct("observed_at", "row_id")).alias("departed_hhmm"))
    )
    return latest.withColumn("departed_at", board_departure_of(latest, params))


def board_summary(board: DataFrame, params: Params) -> DataFrame:
    """One pass over a service's board rows: minimum, note, departure and the verdict's parts.

    Every aggregate merges partially before the shuffle, so a service that holds a large
    share of the rows costs no more than its tasks' partial results.
    """
    ok = F.col("fetch_status") == "ok"
    percent, seen_at = F.col("percent_available"), F.col("observed_at")
    scheduled = combine_local(F.col("service_date"), F.col("hhmm"), params.zone)
    before = ok & percent.isNotNull() & (seen_at <= scheduled)
    gone = ok & row_departed(F.col("departed_hhmm"), F.col("status_text"))
    summary = board.filter(F.col("hhmm").isNotNull()).groupBy(*BOARD_KEY).agg(
        F.min("percent_available").alias("deck_space_min"),
        F.count(F.when(ok, 1)).alias("n_rows"),
        F.bool_or(F.when(ok, says_full(F.col("status_text")))).alias("left_full"),
        F.coalesce(
            F.bool_or(ok & (F.lower("status_text") == "cancelled")), F.lit(False)
        ).alias("said_cancelled"),
        F.count(F.when(ok & percent.isNotNull(), 1)).alias("n_percent"),
        F.max(F.when(before, seen_at)).alias("last_before"),
        F.min(F.when(before & (percent <= 0), seen_at)).alias("first_full_at"),
        F.min(F.when(gone, seen_at)).alias("departed_first_seen"),
        F.max(F.when(ok, seen_at)).alias("watched_until"),
        F.max_by(
            "departed_hhmm",
            F.when(ok & F.col("departed_hhmm").isNotNull(), F.struct("observed_at", "row_id")),
        ).alias("departed_hhmm"),
    )
    return classify_board(
        summary.withColumn(
            "board_departed_at",
            F.when(F.col("departed_hhmm").isNotNull(), board_departure_of(summary, params)),
        ),
        params,
    )


def silence_outcome(params: Params) -> Column:
    """A board without percentages: departed, watched long enough, and never a full note."""
    watched = seconds_between(F.col("watched_until"), F.col("departed_first_seen"))
    return F.when(
        ~F.coalesce(F.col("left_full"), F.lit(False)) & (watched >= params.note_wait_minutes * 60),
        "boarded",
    ).otherwise("unknown")


def classify_board(summary: DataFrame, params: Params) -> DataFrame:
    """Add deck_outcome, deck_filled_at and deck_confidence."""
    scheduled = combine_local(F.col("service_date"), F.col("hhmm"), params.zone)
    gap = seconds_between(scheduled, F.col("last_before")) / 60
    silent = F.col("n_percent") == 0
    outcome = (
        F.when(F.col("said_cancelled"), "cancelled")
        .when(silent, silence_outcome(params))
        .when(F.col("last_before").isNull(), "unknown")
        .when(F.col("first_full_at").isNotNull(), "filled")
        .when(gap > 45, "unknown")
        .otherwise("boarded")
    )
    confidence = (
        F.when(F.col("deck_outcome") == "cancelled", 0.6)
        .when(F.col("deck_outcome") == "filled", 0.7)
        .when((F.col("deck_outcome") == "boarded") & silent, 0.55)
        .when((F.col("deck_outcome") == "boarded") & (gap <= 20), 0.65)
        .when(F.col("deck_outcome") == "boarded", 0.5)
    )
    return summary.withColumn("deck_outcome", outcome).withColumns(
        {
            "deck_filled_at": F.when(F.col("deck_outcome") == "filled", F.col("first_full_at")),
            "deck_confidence": confidence,
        }
    )


def published_departures(board: DataFrame, params: Params) -> DataFrame:
    """Distinct published departures with their instants, as the ledger's anchors."""
    distinct = (
        board.filter(
            (F.col("fetch_status") == "ok")
            & F.col("departed_hhmm").isNotNull() & F.col("hhmm").isNotNull()
        )
        .select(*BOARD_KEY, "departed_hhmm")
        .distinct()
    )
    return distinct.withColumn("left_at", board_departure_of(distinct, params))


def departures_in_span(departures: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    """Published departures within the matching distance of each ledger day.

    spans(route, ledger_date, span_start, span_end). A published service date can only matter
    to its own ledger day and the next, so the join is on (route, date).
    """
    near = departures.select(
        "*",
        F.explode(
            F.array(
                F.date_sub("service_date", 1), F.col("service_date"), F.date_add("service_date", 1)
            )
        ).alias("ledger_date"),
    )
    pad = params.same_departure_minutes
    return near.join(spans, ["route", "ledger_date"]).filter(
        F.col("left_at").between(
            add_minutes(F.col("span_start"), -pad), add_minutes(F.col("span_end"), pad)
        )
    )


def board_state(board: DataFrame) -> DataFrame:
    """Per terminal-day: published departures, what the latest scrape lists, when it was.

    Reduced to one row per service first; the day then gathers at most its timetable.
    """
    ok = board.filter(F.col("fetch_status") == "ok")
    services = (
        ok.groupBy(*BOARD_KEY)
        .agg(
            F.max_by(
                "departed_hhmm",
                F.when(F.col("departed_hhmm").isNotNull(), F.struct("observed_at", "row_id")),
            ).alias("departed_hhmm"),
            F.max("observed_at").alias("last_seen"),
        )
    )
    day = W.partitionBy("route", "terminal", "service_date")
    return (
        services.withColumn("board_at", F.max("last_seen").over(day))
        .filter(F.col("hhmm").isNotNull())
        .withColumn("listed", F.col("last_seen") == F.col("board_at"))
    )
