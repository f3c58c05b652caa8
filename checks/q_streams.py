"""Streams over the events file, run to its end and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound, instants, one_route
from checks.q_evidence import KEY, KEYS, _evidence
from checks.registry import query
from checks.views import SLOTS, shape, spark_sql
from tidewait.functions.clock import add_minutes, combine_local, local_date, local_hhmm
from tidewait.operators import ledger, live
from tidewait.plans.service_record import service_records
from tidewait.sources.tables import fresh_dir
from tidewait.streaming import feeds


def _stream(b: Bound, view: str) -> DataFrame:
    """A bound view with the events arriving as a stream."""
    schema = b.spark.read.parquet(f"{b.sf_dir.rstrip('/')}/events.parquet").schema
    events = b.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{b.sf_dir.rstrip('/')}/events*.parquet"
    )
    events.createOrReplaceTempView("arriving_events")
    text = spark_sql(f"select * from {view}", b.sf_dir, {"events": "arriving_events"})
    return instants(b.spark.sql(text))


def _positions(b: Bound) -> DataFrame:
    return _stream(b, "v_positions").withColumn("route", one_route())


def _run(b: Bound, stream: DataFrame, write=feeds.write_available) -> DataFrame:
    path = fresh_dir(b.spark, "stream")
    write(stream, f"{path}/rows", f"{path}/progress").awaitTermination()
    return b.spark.read.parquet(f"{path}/rows")


@query("str01_dedupe_on_feed_time", """
select distinct vessel, date_trunc('minute', reported_at) as reported_at from v_positions""")
def _(b: Bound) -> DataFrame:
    polled = _positions(b).withColumn("reported_at", F.date_trunc("minute", "reported_at"))
    return _run(b, feeds.dedupe_on_feed_time(polled, "2 hours")).select("vessel", "reported_at")


@query("str02_departure_detection", """
select vessel, cast(reported_at as date) as ledger_date, reported_at as moment from (select *, lag(moving) over (partition by vessel, cast(reported_at as date) order by reported_at) as was from (
 select *, case lower(trim(status)) when 'under way' then true when 'stopped' then false else speed_knots>0 end as moving from v_positions) where moving is not null)
where moving and was=false""")
def _(b: Bound) -> DataFrame:
    found = _run(b, feeds.departure_detection(_positions(b), "2 hours", b.params))
    rest = feeds.held_back(instants(b.view("v_positions")), "reported_at", "2 hours").withColumns(
        {"route": one_route(), "ledger_date": local_date(F.col("reported_at"), b.params.zone)}
    )
    tail = ledger.transitions(rest, ["route", "vessel", "ledger_date"]).withColumn("moment", F.col("reported_at"))
    whole = feeds.closed(found, tail, ["route", "vessel", "ledger_date", "moment"])
    return whole.select("vessel", "ledger_date", "moment")


shape("o_silent", """
select terminal, service_date, s.hhmm, observed_at, status_text, late_minutes, fetch_status from v_board b join v_slots s using (terminal, slot) where fetch_status='ok'""")


def _silent_board(b: Bound, rows: DataFrame) -> DataFrame:
    """Board rows with their service's clock and no percentages; the slots are a lookup in the row, not a join."""
    slots = F.create_map(*[F.lit(x) for r in SLOTS for x in (f"{r[0]}{r[1]}", r[2])])
    timed = rows.withColumns(
        {
            "route": one_route(), "percent_available": F.lit(None).cast("int"),
            "hhmm": F.try_element_at(slots, F.concat("terminal", F.col("slot").cast("string"))),
        }
    )
    scheduled = combine_local(F.col("service_date"), F.col("hhmm"), b.params.zone)
    return timed.withColumn("departed_hhmm", local_hhmm(add_minutes(scheduled, F.col("late_minutes")), b.params.zone))


@query("str03_note_wait_timer", """
select terminal, service_date, hhmm, 1 as times, case when first_gone is null or noted or watched - first_gone < interval 15 minute then 'unknown' else 'boarded' end as outcome from (
 select terminal, service_date, hhmm, min(observed_at) filter (late_minutes is not null or status_text ilike 'departed%') as first_gone, max(observed_at) as watched, bool_or(status_text ilike '%loading maximum%') as noted from o_silent group by 1,2,3)""")
def _(b: Bound) -> DataFrame:
    done = _run(b, feeds.note_wait(_silent_board(b, _stream(b, "v_board")), "2 hours", b.params))
    whole = _silent_board(b, instants(b.view("v_board")))
    tail = feeds.note_wait_rest(feeds.held_back(whole, "observed_at", "2 hours"), b.params)
    found = feeds.closed(done, tail, ["terminal", "service_date", "hhmm"])
    return found.groupBy("terminal", "service_date", "hhmm").agg(F.count(F.lit(1)).cast("int").alias("times"), F.max("outcome").alias("outcome"))


@query("str04_feed_freshness", """
select event_type, max(ts) as latest_at, max(ts) >= timestamp '2024-01-20 12:00:00' - interval 20 minute as fresh from {events} where ts <= timestamp '2024-01-20 12:00:00' group by 1""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return live.feed_freshness(b.table("events"), ["event_type"], "ts", now, 20)


@query("str05_trailing_reaggregation", f"select {KEYS}, outcome, n_frames, method, departed_at from o_final")
def _(b: Bound) -> DataFrame:
    path = fresh_dir(b.spark, "records")
    whole = _evidence(b)

    def recompute(dates: DataFrame) -> DataFrame:
        # A batch touches few dates; each stretch of them is read by itself.
        runs = feeds.date_runs(r.service_date for r in dates.select("service_date").distinct().collect())
        parts = [service_records(b.services, whole, b.params, run) for run in runs]
        records = reduce(DataFrame.unionByName, parts)
        return records.select(*KEY, "outcome", "n_frames", "method", "departed_at")

    arriving = _stream(b, "v_readings").select("service_date")
    feeds.trailing_reaggregation(arriving, recompute, f"{path}/rows", f"{path}/progress").awaitTermination()
    return b.spark.read.parquet(f"{path}/rows").select(*KEY, "outcome", "n_frames", "method", "departed_at")


@query("str06_tumbling_buckets", """
select date_trunc('hour', captured_at) as hour, terminal, camera, count(*) as frames from v_readings group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    done = _run(b, feeds.hourly_counts(_stream(b, "v_readings"), "2 hours"))
    rest = feeds.held_back(instants(b.view("v_readings")), "captured_at", "2 hours")
    tail = rest.groupBy(F.date_trunc("hour", "captured_at").alias("hour"), "terminal", "camera").agg(F.count(F.lit(1)).alias("frames"))
    return feeds.closed(done, tail, ["hour", "terminal", "camera"])
