"""Streaming forms of the feed operators; each has a batch twin with the same answer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewait.functions.claims import is_moving, row_departed, says_full
from tidewait.functions.clock import local_date, local_time
from tidewait.operators.board import silence_outcome
from tidewait.params import Params
from tidewait.sources.sinks import overwrite_dates


def dedupe_on_feed_time(positions: DataFrame, delay: str) -> DataFrame:
    """One reading per (route, vessel, feed time), state dropped once the watermark passes."""
    return positions.withWatermark("reported_at", delay).dropDuplicatesWithinWatermark(
        ["route", "vessel", "reported_at"]
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Edges(StatefulProcessor):
    """Stop-to-move edges of one vessel's day.

    Readings wait in a list until the watermark has passed them, as an earlier one may still arrive; a timer
    at the earliest then takes all that are due, in order of feed time. A last timer, two days after
    the day began, lets the state go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row_id long, moving boolean")
        self.berthed = handle.getValueState("berthed", "berthed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [(r.at, r.row_id, r.moving) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] < limit * 1000], [x for x in held if x[0] >= limit * 1000]
        berthed = bool(self.berthed.exists() and self.berthed.get()[0])
        found = []
        for at, _, moving in due:
            if moving and berthed:
                found.append(at)
            berthed = not moving
        over = _day_start_ms(key[2]) + 2 * DAY_MS
        if not later and limit >= over:
            self.waiting.clear()
            self.berthed.clear()
        else:
            self.waiting.put(later) if later else self.waiting.clear()
            self.berthed.update((berthed,))
            self.handle.registerTimer(later[0][0] // 1000 + 1 if later else max(over, limit + 1))
        for at in found:
            yield Row(route=key[0], vessel=key[1], ledger_date=key[2], moment=EPOCH + timedelta(microseconds=at))

    def close(self) -> None:
        pass


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DAY_MS = 86_400_000


def _day_start_ms(day: date) -> int:
    return (day - EPOCH.date()).days * DAY_MS


def departure_detection(positions: DataFrame, delay: str, params: Params) -> DataFrame:
    """Departures per (route, vessel, local date), emitted as the watermark passes them.

    Readings may arrive in any order within the delay; ties of time go by row_id. A key is one vessel's day, so state
    stays small and days of one busy vessel run on different tasks. State is kept by the session's RocksDB provider,
    which is set here: the timers and lists of this operator need it.
    """
    positions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    speaking = (
        positions.filter(F.col("reported_at").isNotNull())
        .withWatermark("reported_at", delay)
        .select(
            "route", "vessel", local_date(F.col("reported_at"), params.zone).alias("ledger_date"),
            "reported_at", F.unix_micros("reported_at").alias("at"), F.col("row_id").cast("long").alias("row_id"),
            is_moving(F.col("status"), F.col("speed_knots")).alias("moving"),
        )
        .filter(F.col("moving").isNotNull())
    )
    return speaking.groupBy("route", "vessel", "ledger_date").transformWithState(
        _Edges(), "route string, vessel string, ledger_date date, moment timestamp", "append", "eventTime"
    )


def note_wait(board: DataFrame, delay: str, params: Params) -> DataFrame:
    """The verdict on the board's silence, once for every service.

    All rows of a service lie in one local day. A full note may still land on its last minute, so the verdict is
    final, and is emitted, when the watermark passes the end of that day; the state goes with it. Run in append mode.
    """
    ok = silent_rows(board, params)
    totals = (
        ok.withWatermark("local_at", delay)
        .groupBy(F.window("local_at", "1 day"), *SILENT_KEY)
        .agg(*_silence())
    )
    return _silent_verdict(totals, params)


def note_wait_rest(board: DataFrame, params: Params) -> DataFrame:
    """The same verdicts from a table: the batch twin, and the tail of an ended stream."""
    return _silent_verdict(silent_rows(board, params).groupBy(F.window("local_at", "1 day"), *SILENT_KEY).agg(*_silence()), params)


SILENT_KEY = ["route", "terminal", "service_date", "hhmm"]


def silent_rows(board: DataFrame, params: Params) -> DataFrame:
    """Board rows that name a service, with the local time they were seen at."""
    named = board.filter((F.col("fetch_status") == "ok") & F.col("hhmm").isNotNull())
    return named.withColumn("local_at", local_time(F.col("observed_at"), params.zone))


def _silence() -> list[Column]:
    gone = row_departed(F.col("departed_hhmm"), F.col("status_text"))
    return [
        F.min(F.when(gone, F.col("observed_at"))).alias("departed_first_seen"),
        F.max("observed_at").alias("watched_until"),
        F.bool_or(says_full(F.col("status_text"))).alias("left_full"),
        F.count("percent_available").alias("n_percent"),
    ]


def _silent_verdict(totals: DataFrame, params: Params) -> DataFrame:
    return totals.filter(F.col("n_percent") == 0).select(
        *SILENT_KEY, "departed_first_seen", "watched_until", silence_outcome(params).alias("outcome")
    )


def hourly_counts(frames: DataFrame, delay: str) -> DataFrame:
    """Frames per terminal, camera and hour, each hour emitted once it is complete."""
    return (
        frames.withWatermark("captured_at", delay)
        .groupBy(F.window("captured_at", "1 hour"), "terminal", "camera")
        .agg(F.count(F.lit(1)).alias("frames"))
        .select(F.col("window.start").alias("hour"), "terminal", "camera", "frames")
    )


def held_back(arrived: DataFrame, at: str, delay: str) -> DataFrame:
    """The rows of an ended stream from the start of the local day before its last watermark on: all that
    its windows and days may not have emitted yet."""
    last = arrived.groupBy().agg((F.max(at) - F.expr(f"interval {delay}")).alias("_last"))
    return arrived.join(last, F.col(at) >= F.date_trunc("day", F.col("_last") - F.expr("interval 1 day"))).drop("_last")


def closed(emitted: DataFrame, tail: DataFrame, keys: list[str]) -> DataFrame:
    """What a stream emitted and, once its input has ended, what it still held: `tail` is the batch
    answer over the rows of held_back."""
    return emitted.unionByName(tail.join(emitted.select(*keys), keys, "left_anti").select(*emitted.columns))


def date_runs(dates: Iterable[date]) -> list[tuple[date, date]]:
    """Dates as stretches of consecutive ones, first and last: far dates do not bring the days between them."""
    runs: list[tuple[date, date]] = []
    for day in sorted(set(dates)):
        if runs and day - runs[-1][1] <= timedelta(days=1):
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def trailing_reaggregation(stream: DataFrame, recompute: Callable[[DataFrame], DataFrame], path: str,
                           checkpoint: str, trailing_days: int = 3) -> StreamingQuery:
    """Recompute and overwrite the dates a batch touches and the days trailing its newest.

    `recompute` maps a table of service_date to those dates' records, reading evidence from
    its own tables; writing whole dates makes a replayed batch harmless.
    """

    def apply(batch: DataFrame, _: int) -> None:
        touched = batch.select("service_date").distinct()
        if touched.isEmpty():
            return
        newest = touched.groupBy().agg(F.max("service_date").alias("d")).filter(F.col("d").isNotNull())
        trailing = newest.select(
            F.explode(F.sequence(F.date_sub("d", trailing_days - 1), F.col("d"))).alias("service_date")
        )
        overwrite_dates(recompute(touched.union(trailing).distinct()), path)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything now available to a parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
