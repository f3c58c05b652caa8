"""The driver's tables in the shapes the operators read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import spark_sql
from tidewait.functions.calendar import with_calendar
from tidewait.functions.claims import WAITED, axes_from_outcome
from tidewait.functions.clock import add_minutes, combine_local, local_hhmm
from tidewait.operators.intervals import unique_frames
from tidewait.operators.ledger import unique_positions
from tidewait.operators.services import expand_timetable
from tidewait.params import Params
from tidewait.sources.sinks import new_rows

PARAMS = Params(zone="UTC")


class Bound:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS):
        self.spark, self.sf_dir, self.params = spark, sf_dir, params

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return instants(df)

    def sql(self, text: str) -> DataFrame:
        return instants(self.spark.sql(spark_sql(text, self.sf_dir)))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    @cached_property
    def terminals(self) -> DataFrame:
        return self.spark.sql(
            """select * from values ('r1','A','B',true,false,true), ('r1','B','A',false,true,false)
            as t(route, terminal, destination, berth_visible, clear_needs_departure, full_lanes_at_capacity)"""
        )

    @cached_property
    def blocks(self) -> DataFrame:
        return self.view("v_blocks").select(
            "block_no", "terminal", F.lit(None).cast("string").alias("route"),
            F.col("eff_from").alias("effective_from"), F.col("eff_to").alias("effective_to"),
            F.transform(F.split("days", ""), lambda c: c.cast("int")).alias("days"),
            F.split("departures", ",").alias("departures"),
        )

    @cached_property
    def event_days(self) -> DataFrame:
        return self.table("events").select(F.to_date("ts").alias("service_date"))

    @cached_property
    def services(self) -> DataFrame:
        return expand_timetable(self.event_days, self.blocks, self.terminals, self.params)

    @cached_property
    def frames(self) -> DataFrame:
        """Frames with the columns of the one reading each has."""
        rows = self.view("v_readings").withColumns(
            {
                "captured_at": F.date_trunc("second", "captured_at"),
                "path": F.when(F.col("status") == "ok", F.concat(F.lit("f/"), F.col("frame_id").cast("string"))),
            }
        )
        return unique_frames(rows)

    @cached_property
    def readings(self) -> DataFrame:
        return self.frames.filter(F.col("status") == "ok")

    @cached_property
    def _slots(self) -> DataFrame:
        return self.view("v_slots")

    def _timed(self, df: DataFrame, terminal: str) -> DataFrame:
        slots = self._slots.select(F.col("terminal").alias(terminal), "slot", F.col("hhmm").alias("depart_hhmm"))
        timed = df.join(slots, [terminal, "slot"]).drop("slot")
        return timed.withColumn(
            "scheduled", combine_local(F.col("service_date"), F.col("depart_hhmm"), self.params.zone)
        )

    @cached_property
    def board(self) -> DataFrame:
        rows = self._timed(self.view("v_board"), "terminal").select(
            "row_id", one_route(), "terminal",
            F.date_trunc("second", "observed_at").alias("observed_at"), "service_date",
            F.col("depart_hhmm").alias("hhmm"), "percent_available", "status_text",
            local_hhmm(add_minutes(F.col("scheduled"), F.col("late_minutes")), self.params.zone).alias("departed_hhmm"),
            "fetch_status",
        )
        return new_rows(None, rows, ["route", "terminal", "observed_at", "hhmm"], ["row_id"])

    @cached_property
    def positions(self) -> DataFrame:
        rows = self.view("v_positions").select(
            "row_id", one_route(), "vessel",
            F.date_trunc("second", "reported_at").alias("reported_at"), "status", "speed_knots",
        )
        return unique_positions(rows)

    @cached_property
    def reports(self) -> DataFrame:
        rows = self._timed(self.view("v_reports"), "origin")
        return rows.select(
            "report_id", "route", "origin", "service_date", "depart_hhmm", "boarded", "sailings_waited",
            add_minutes(F.col("scheduled"), -F.col("lead_minutes")).alias("joined_at"),
            add_minutes(F.col("scheduled"), F.col("late_minutes")).alias("departed_at"),
            "sailing_id", "l_linenumber", "l_partkey", "scheduled",
        )

    @cached_property
    def event_reports(self) -> DataFrame:
        """Reports about the services of the event feeds: what the merge reads of a report, and no more."""
        rows = self._timed(self.view("v_event_reports"), "origin")
        return rows.select(one_route(), "origin", "service_date", "depart_hhmm", "boarded", "sailings_waited")

    @cached_property
    def records(self) -> DataFrame:
        rows = with_calendar(self._timed(self.view("v_records"), "origin"))
        filled, left = axes_from_outcome(F.col("outcome"))
        left = F.when(F.col("outcome") == "filled", F.col("left_behind_hint")).otherwise(left)
        stored = ~F.col("axes_missing")
        return rows.select(
            F.col("sailing_id").alias("service_id"), "route", "origin", "service_date", "depart_hhmm",
            "scheduled", "day_type", "season", "long_weekend", "outcome", "method", "left_full",
            F.when(stored, filled).alias("filled"), F.when(stored, left).alias("left_behind"),
            F.when(
                F.col("outcome").isin("filled", *WAITED),
                add_minutes(F.col("scheduled"), -F.col("fill_lead_raw")),
            ).alias("filled_at"),
            add_minutes(F.col("scheduled"), F.col("left_late")).alias("departed_at"),
            F.when(
                F.col("left_late").isNotNull(), F.when(F.col("left_late") % 2 == 0, "board").otherwise("tracking")
            ).alias("departed_source"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        from tidewait.functions.wind import wind_band

        return self.view("v_forecasts").select(
            F.col("site").cast("string").alias("site"), "route", "service_date",
            add_minutes(F.col("issued_on").cast("timestamp"), (F.col("issue_seq") % 1440).cast("int")).alias("issued_at"),
            "kind", "wind_max_kt", wind_band(F.col("wind_max_kt")).alias("band"),
            F.when(F.col("ok"), "ok").otherwise("error").alias("fetch_status"),
            "issue_seq", "l_orderkey", "l_linenumber", "cents",
        )


def one_route() -> Column:
    """The route of the event feeds, read off a row so that joins on it stay equality joins."""
    return F.when(F.col("row_id") >= 0, "r1").otherwise("r2").alias("route")


def instants(df: DataFrame) -> DataFrame:
    """Zone-less file timestamps as instants; the session runs in UTC."""
    plain = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in plain}) if plain else df
