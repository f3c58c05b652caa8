"""Services, interval joins, camera, board and report evidence, and the merged record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.registry import query
from checks.views import shape
from tidewait.functions.claims import classify_bands, classify_counts
from tidewait.functions.clock import add_minutes
from tidewait.operators import board as brd
from tidewait.operators import evidence as ev
from tidewait.operators import intervals as iv
from tidewait.operators import services as sv
from tidewait.operators.records import outcome_totals, tags_per_date
from tidewait.operators.reports import (
    report_rollup,
    report_summary,
    reported_departures,
    reports_for_services,
    validate_reports,
)
from tidewait.plans.service_record import Evidence, service_records, timed_services
from tidewait.sources.timetable import timetable_blocks

KEY = ["route", "origin", "service_date", "depart_hhmm"]
KEYS = "route, origin, service_date, depart_hhmm"


# ---- timetable --------------------------------------------------------------------------
@query("src02_timetable_source", """
select block_no, terminal, array_to_string(list_sort(list_distinct(list_transform(string_split(days,''), lambda c: cast(c as int)))), ',') as days,
 departures, n from (select *, (select count(*) from {events} where cast(ts as date) between eff_from and eff_to) as n from v_blocks)""")
def _(b: Bound) -> DataFrame:
    names = F.array(*[F.lit(d) for d in ("Monday", "tue", "WED", "thurs", "fri", "sat", "Sunday")])
    raw = b.blocks.select(
        "block_no", "terminal", "route", "effective_from", "effective_to",
        F.transform("days", lambda d: F.element_at(names, d + 1)).alias("days"),
        F.reverse("departures").alias("departures"),
    )
    blocks, _ = timetable_blocks(raw)
    dates = blocks.select("block_no", F.explode(F.sequence("effective_from", "effective_to")).alias("service_date"))
    events = b.event_days.groupBy("service_date").agg(F.count(F.lit(1)).alias("c"))
    seen = dates.join(events, "service_date").groupBy("block_no").agg(F.sum("c").alias("n"))
    return blocks.join(seen, "block_no").select(
        "block_no", "terminal", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"),
        F.array_join("departures", ",").alias("departures"), "n",
    )


@query("joi01_expand_timetable", f"""
select {KEYS}, destination, scheduled, day_type, season, block_no from o_services""")
def _(b: Bound) -> DataFrame:
    return b.services.select(*KEY, "destination", "scheduled", "day_type", "season", "block_no")


@query("win01_neighbour_departures", f"select {KEYS}, prev_dep as previous_departure, next_dep as next_departure from o_neigh")
def _(b: Bound) -> DataFrame:
    return sv.with_neighbours(b.services).select(*KEY, "previous_departure", "next_departure")


@query("top03_upcoming_services", f"""
select {KEYS}, scheduled from o_services where scheduled >= timestamp '2024-01-19 15:10:00' and service_date between date '2024-01-19' and date '2024-01-26'
order by scheduled, origin limit 12""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-01-19 15:10:00").cast("timestamp")
    return sv.upcoming_services(b.services, now, 12, b.params).select(*KEY, "scheduled")


@query("top04_service_times", """
select route, origin, service_date, string_agg(depart_hhmm, ',' order by depart_hhmm) as times,
 case when service_date=date '2024-01-19' then coalesce(min(depart_hhmm) filter (depart_hhmm>='15:10'), max(depart_hhmm)) else min(depart_hhmm) end as default_hhmm
from o_services group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-01-19 15:10:00").cast("timestamp")
    return sv.service_times(b.services, now, b.params).select(
        "route", "origin", "service_date", F.array_join("times", ",").alias("times"), "default_hhmm"
    )


@query("top05_expected_times", """
select distinct cast(ev.ts as date) as shown_on, route, origin, depart_hhmm from (select distinct cast(ts as date) as ts from {events}) ev
join o_services s on s.service_date between ev.ts - 1 and ev.ts + 1""")
def _(b: Bound) -> DataFrame:
    return sv.expected_times(b.services, b.event_days)


# ---- interval joins ---------------------------------------------------------------------
shape("o_window", """
select n.*, greatest(scheduled - interval 120 minute, coalesce(prev_dep + interval 12 minute, timestamp '1900-01-01')) as w0,
 least(scheduled + interval 45 minute, coalesce(next_dep - interval 5 minute, timestamp '2900-01-01')) as w1 from o_neigh n""")
shape("o_pairs", """
select w.*, f.frame_id, f.captured_at as ts, f.version, f.vehicle_count as cnt, f.band, f.dock, f.beyond, f.confidence
from o_window w join o_usable f on f.terminal=w.origin and f.captured_at between w.w0 and w.w1""")


@query("joi02_readings_in_window", f"select {KEYS}, frame_id, ts as captured_at from o_pairs")
def _(b: Bound) -> DataFrame:
    pairs = iv.readings_in_window(sv.with_neighbours(b.services), b.readings, b.params)
    return pairs.select(*KEY, "frame_id", "captured_at")


shape("o_main", "select * from o_frames where status='ok' and camera='main'")
shape("o_nearest", """
select route, origin, s.service_date, depart_hhmm, scheduled, off as "offset", arg_min(frame_id, (abs(epoch(captured_at - (scheduled + to_minutes(off)))), captured_at, frame_id)) as frame_id,
 arg_min(captured_at, (abs(epoch(captured_at - (scheduled + to_minutes(off)))), captured_at, frame_id)) as captured_at
from o_services s cross join (select unnest([-30,-10,15,30]) as off) join o_main f on f.terminal=origin and f.captured_at between scheduled + to_minutes(off-10) and scheduled + to_minutes(off+10) group by 1,2,3,4,5,6""")


@query("joi03_nearest_frame_per_offset", f'select {KEYS}, "offset", frame_id, captured_at from o_nearest')
def _(b: Bound) -> DataFrame:
    found = iv.nearest_frames(b.services, iv.readable_frames(b.frames), b.params)
    return found.select(*KEY, "offset", "frame_id", "captured_at")


@query("joi04_frames_for_service", f"""
select route, origin, s.service_date, depart_hhmm, frame_id from o_services s join o_main f on f.terminal=s.origin
 and f.captured_at between scheduled - interval 120 minute and scheduled + interval 45 minute""")
def _(b: Bound) -> DataFrame:
    return iv.frames_for_services(b.services, iv.readable_frames(b.frames), b.params).select(*KEY, "frame_id")


@query("joi05_pending_readings", """
select frame_id, terminal, captured_at from o_main where version<>'lane' order by captured_at, frame_id limit 200""")
def _(b: Bound) -> DataFrame:
    return iv.pending_readings(b.frames, b.readings, "lane", 200).select("frame_id", "terminal", "captured_at")


@query("prj10_frame_filter", """
select frame_id, captured_at from o_main where terminal='A' and version<>'model'
 and captured_at between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-27 12:00:00'""")
def _(b: Bound) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-03 00:00:00", "2024-01-27 12:00:00"))
    return iv.frames_between(
        b.frames, b.readings, "model", terminal="A", start=start, end=end
    ).select("frame_id", "captured_at")


@query("top01_recent_frames", """
select terminal, camera, frame_id, captured_at, rank from (select *, row_number() over (partition by terminal, camera order by captured_at desc, frame_id desc) as rank
 from o_frames where status='ok' and captured_at between timestamp '2024-01-20 10:30:00' and timestamp '2024-01-20 12:00:00') where rank<=3""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return iv.recent_frames(b.frames, now, b.params).select("terminal", "camera", "frame_id", "captured_at", "rank")


# ---- camera -----------------------------------------------------------------------------
@query("agg01_best_reading_per_frame", """
select terminal, camera, minute, arg_max(frame_id, (version<>'model', version, frame_id)) as frame_id, max(case when version<>'model' then version end) is not null as geometric
from (select *, date_trunc('minute', captured_at) as minute from v_readings where status='ok') group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    rows = b.view("v_readings").filter("status = 'ok'").withColumn("minute", F.date_trunc("minute", "captured_at"))
    best = ev.best_reading_per_frame(rows, ["terminal", "camera", "minute"], b.params.model_version)
    return best.select("terminal", "camera", "minute", "frame_id", (F.col("version") != "model").alias("geometric"))


shape("o_timed", f"""
select w.*, coalesce(bs.board_departed_at, t.tracked_at) as departed_at,
 case when bs.board_departed_at is not null then 'board' when t.tracked_at is not null then 'tracking' end as departed_source,
 bs.deck_space_min, bs.left_full, coalesce(bs.outcome,'unknown') as deck, bs.filled_at as deck_filled_at, bs.deck_confidence,
 t.tracked_at, bs.board_departed_at
from o_window w left join o_board_class bs on bs.origin=w.origin and bs.service_date=w.service_date and bs.depart_hhmm=w.depart_hhmm
left join o_tracked t on t.origin=w.origin and t.service_date=w.service_date and t.depart_hhmm=w.depart_hhmm""")
shape("o_p", """
select p.*, t.departed_at from o_pairs p join o_timed t on t.origin=p.origin and t.service_date=p.service_date and t.depart_hhmm=p.depart_hhmm""")
shape("o_dock", """
select origin, service_date, depart_hhmm, max(ts) filter (dock and ts >= scheduled - interval 20 minute) as last_dock from o_p group by all""")
shape("o_gone", """
select p.origin, p.service_date, p.depart_hhmm, min(ts) filter (ts > last_dock) as camera_left, any_value(last_dock) as last_dock
from o_p p join o_dock d using (origin, service_date, depart_hhmm) group by all""")
shape("o_settled", """
select p.*, g.camera_left, coalesce(p.departed_at, g.camera_left) as left_at, p.departed_at is null and g.last_dock is not null and g.camera_left is null as still,
 greatest(scheduled + interval 12 minute, coalesce(p.departed_at, g.camera_left, scheduled)) as settle,
 case when band is not null then band<>'empty' else cnt>0 end as occ
from o_p p join o_gone g using (origin, service_date, depart_hhmm)""")
shape("o_lastocc", "select origin, service_date, depart_hhmm, max(ts) filter (occ and ts<=settle) as last_occ from o_settled group by all")
shape("o_cam", """
select origin, service_date, depart_hhmm, count(*) as n_frames, any_value(left_at) as left_at, any_value(still) as still,
 max(cnt) filter (ts<=scheduled) as peak_queue,
 max(list_position(['empty','light','moderate','heavy','overflowing'], band)) filter (ts<=scheduled) as peak_rank,
 arg_max(cnt, (ts,frame_id)) filter (ts<=scheduled and ts>=scheduled - interval 20 minute and cnt is not null) as queue_at_departure,
 arg_max(band, (ts,frame_id)) filter (ts<=scheduled and ts>=scheduled - interval 20 minute and band is not null) as band_at_departure,
 arg_min(cnt, (ts,frame_id)) filter (ts>=settle and cnt is not null) as residual_queue,
 arg_min(band, (ts,frame_id)) filter (ts>=settle and band is not null) as residual_band,
 arg_max(band, (ts,frame_id)) filter (ts>=scheduled - interval 20 minute and ts<=settle and band is not null) as band_when_left,
 coalesce(bool_or(beyond) filter (ts<=scheduled and cnt is not null), false) as truncated,
 min(ts) filter (ts<=scheduled and occ) as queue_started_at, min(ts) filter (ts>last_occ and not occ) as cleared_at,
 min(ts) filter (ts<=scheduled and ((version='extent' and band='heavy') or (version='lane' and band='overflowing' and origin='A'))) as fill_mark,
 count(*) filter ((ts<=scheduled or ts>=settle) and band is not null) as n_banded,
 floor((2*sum(cast(round(confidence*1e6) as bigint)) filter ((ts<=scheduled or ts>=settle) and band is not null) + 1000*count(*) filter ((ts<=scheduled or ts>=settle) and band is not null)) / (2000*count(*) filter ((ts<=scheduled or ts>=settle) and band is not null)))/1000 as band_conf,
 floor((2*sum(cast(round(confidence*1e6) as bigint)) filter ((ts<=scheduled or ts>=settle) and cnt is not null) + 1000*count(*) filter ((ts<=scheduled or ts>=settle) and cnt is not null)) / (2000*count(*) filter ((ts<=scheduled or ts>=settle) and cnt is not null)))/1000 as count_conf,
 string_agg(distinct version, '+' order by version) filter ((ts<=scheduled or ts>=settle) and band is not null) as band_src,
 string_agg(distinct version, '+' order by version) filter ((ts<=scheduled or ts>=settle) and cnt is not null) as count_src
from o_settled join o_lastocc using (origin, service_date, depart_hhmm) group by 1,2,3""")


def _timed(b: Bound) -> DataFrame:
    return timed_services(sv.with_neighbours(b.services), _evidence(b), b.params)


def _evidence(b: Bound) -> Evidence:
    return Evidence(b.readings, b.board, b.positions, b.event_reports, b.terminals)


def _summary(b: Bound) -> DataFrame:
    windows = _timed(b).select(
        *KEY, "scheduled", "previous_departure", "next_departure", "departed_at", "full_lanes_at_capacity"
    )
    return ev.camera_summary(iv.readings_in_window(windows, b.readings, b.params), b.params)


K3 = "'r1' as route, origin, service_date, depart_hhmm"


@query("agg02_count_measures", f"""
select {K3}, peak_queue, queue_at_departure, residual_queue, n_frames, count_conf as confidence, truncated, 'frames:'||coalesce(count_src,'none') as method from o_cam""")
def _(b: Bound) -> DataFrame:
    used, sources = F.col("used_counts"), F.col("count_sources")
    return _summary(b).select(
        *KEY, "peak_queue", "queue_at_departure", "residual_queue", "n_frames",
        ev.mean_confidence(used).alias("confidence"), "truncated",
        F.concat(
            F.lit("frames:"),
            F.when(F.size(sources) > 0, F.array_join(F.array_sort(sources), "+")).otherwise("none"),
        ).alias("method"),
    )


@query("agg03_peak_band", """
select terminal, service_date, ['empty','light','moderate','heavy','overflowing'][max(list_position(['empty','light','moderate','heavy','overflowing'], band))] as peak_band
from v_readings group by 1,2""")
def _(b: Bound) -> DataFrame:
    return ev.peak_band(b.view("v_readings"), ["terminal", "service_date"])


@query("agg04_first_occupied", f"select {K3}, queue_started_at from o_cam")
def _(b: Bound) -> DataFrame:
    return _summary(b).select(*KEY, "queue_started_at")


@query("agg05_cleared_at", f"select {K3}, cleared_at from o_cam")
def _(b: Bound) -> DataFrame:
    return _summary(b).select(*KEY, "cleared_at")


@query("agg06_departure_from_readings", f"""
select {K3}, camera_left as left_at, last_dock is not null and camera_left is null as still_at_dock from o_gone""")
def _(b: Bound) -> DataFrame:
    pairs = iv.readings_in_window(sv.with_neighbours(b.services), b.readings, b.params)
    return ev.camera_departure(pairs, b.params).groupBy(*KEY).agg(
        F.first("camera_left_at").alias("left_at"), F.first("camera_still").alias("still_at_dock")
    )


def _verdict_columns():
    return (
        F.coalesce(F.col("left_at"), F.col("departed_at")).isNotNull() | F.col("deck_space_min").isNotNull(),
        F.coalesce(F.col("still_at_dock"), F.lit(False)),
        F.col("berth_visible"),
    )


SEEN = "(coalesce(c.left_at, t.departed_at) is not null or t.deck_space_min is not null)"
JOINED = "o_timed t left join o_cam c on c.origin=t.origin and c.service_date=t.service_date and c.depart_hhmm=t.depart_hhmm"


@query("agg10_classify_counts", f"""
select 'r1' as route, t.origin, t.service_date, t.depart_hhmm, case when residual_queue is null or queue_at_departure is null or still then 'unknown' when residual_queue<5 then 'boarded'
 when not {SEEN} then case when t.origin='A' then 'cancelled' else 'unknown' end when residual_queue>125 then 'waited_2plus' else 'waited_1' end as outcome
from {JOINED}""")
def _(b: Bound) -> DataFrame:
    seen, still, berth = _verdict_columns()
    joined = _timed(b).join(_summary(b).drop("scheduled"), KEY, "left")
    verdict = classify_counts(
        F.col("residual_queue"), F.col("queue_at_departure"), seen, still, berth,
        b.params.vessel_capacity, b.params.residual_threshold,
    )
    return joined.select(*KEY, verdict.outcome.alias("outcome"))


@query("agg11_classify_bands", f"""
select 'r1' as route, t.origin, t.service_date, t.depart_hhmm, case when residual_band is null or band_at_departure is null or still then 'unknown'
 when residual_band='empty' then case when t.origin='B' and not {SEEN} then 'unknown' else 'boarded' end
 when not {SEEN} then case when t.origin='A' then 'cancelled' else 'unknown' end when band_when_left='empty' then 'boarded' else 'filled' end as outcome
from {JOINED}""")
def _(b: Bound) -> DataFrame:
    seen, still, berth = _verdict_columns()
    joined = _timed(b).join(_summary(b).drop("scheduled"), KEY, "left")
    empty = F.coalesce(F.col("band_when_left") == "empty", F.lit(False))
    clear = F.col("origin") == "B"
    verdict = classify_bands(
        F.col("residual_band"), F.col("band_at_departure"), seen, still, berth, empty, clear
    )
    return joined.select(*KEY, verdict.outcome.alias("outcome"))


@query("agg12_fill_mark", f"select {K3}, fill_mark from o_cam")
def _(b: Bound) -> DataFrame:
    return _summary(b).select(*KEY, "fill_mark")


# ---- board ------------------------------------------------------------------------------
BK = "route, origin as terminal, service_date, depart_hhmm as hhmm"


@query("agg07_board_minimum", f"select {BK}, deck_space_min from o_board_sum where deck_space_min is not null")
def _(b: Bound) -> DataFrame:
    return brd.board_minimum(b.board)


@query("agg08_classify_board_series", f"""
select {BK}, outcome as deck_outcome, filled_at as deck_filled_at, deck_confidence from o_board_class""")
def _(b: Bound) -> DataFrame:
    return brd.board_summary(b.board, b.params).select(
        *brd.BOARD_KEY, "deck_outcome", "deck_filled_at", "deck_confidence"
    )


@query("agg09_classify_board_silence", """
select route, terminal, service_date, hhmm, case when first_gone is null or noted or watched - first_gone < interval 15 minute then 'unknown' else 'boarded' end as outcome from (
 select route, terminal, service_date, hhmm, min(observed_at) filter (departed_hhmm is not null or status_text ilike 'departed%') as first_gone,
  max(observed_at) as watched, bool_or(status_text ilike '%loading maximum%') as noted from o_board where fetch_status='ok' group by all)""")
def _(b: Bound) -> DataFrame:
    silent = b.board.withColumn("percent_available", F.lit(None).cast("int")).filter("fetch_status = 'ok'")
    summary = brd.board_summary(silent, b.params)
    return summary.select(*brd.BOARD_KEY, brd.silence_outcome(b.params).alias("outcome"))


@query("agg17_board_state", """
select *, last_seen = max(last_seen) over (partition by route, terminal, service_date) as listed, max(last_seen) over (partition by route, terminal, service_date) as board_at from (
 select route, terminal, service_date, hhmm, arg_max(departed_hhmm, (observed_at,row_id)) filter (departed_hhmm is not null) as departed_hhmm, max(observed_at) as last_seen
 from o_board where fetch_status='ok' group by all)""")
def _(b: Bound) -> DataFrame:
    return brd.board_state(b.board)


@query("joi08_published_departures", """
select distinct terminal, service_date, hhmm, departed_hhmm, left_at, ld as ledger_date from o_published, (select distinct cast(reported_at as date) as ld from o_pos)
where left_at between ld - interval 15 minute and ld + interval 1455 minute and ld between service_date - 1 and service_date + 1""")
def _(b: Bound) -> DataFrame:
    days = b.positions.select("route", F.to_date("reported_at").alias("ledger_date")).distinct()
    spans = days.withColumn("span_start", F.col("ledger_date").cast("timestamp")).withColumn(
        "span_end", add_minutes(F.col("span_start"), 1440)
    )
    found = brd.departures_in_span(brd.published_departures(b.board, b.params), spans, b.params)
    return found.select("terminal", "service_date", "hhmm", "departed_hhmm", "left_at", "ledger_date")


@query("joi13_board_departure", f"""
select {BK}, strftime(board_departed_at,'%H:%M') as departed_hhmm, board_departed_at as departed_at from o_board_sum where board_departed_at is not null""")
def _(b: Bound) -> DataFrame:
    return brd.board_departures(b.board, b.params)


# ---- reports ----------------------------------------------------------------------------
shape("o_told", """
select origin, r.service_date, s.hhmm as depart_hhmm, case when not bool_or(not boarded) then 'boarded' when max(sailings_waited) filter (not boarded)>=2 then 'waited_2plus' when max(sailings_waited) filter (not boarded)>=1 then 'waited_1' else 'filled' end as outcome,
 round(least(0.95e0, 0.8e0+0.05e0*count(*)),2) as confidence from v_event_reports r join v_slots s on s.terminal=r.origin and s.slot=r.slot group by 1,2,3""")
shape("o_rep_sum", """
select route, origin, service_date, depart_hhmm, count(*) as n, bool_or(not boarded) as missed, max(sailings_waited) filter (not boarded) as wait,
 case when not bool_or(not boarded) then 'boarded' when max(sailings_waited) filter (not boarded)>=2 then 'waited_2plus' when max(sailings_waited) filter (not boarded)>=1 then 'waited_1' else 'filled' end as outcome,
 round(least(0.95e0, 0.8e0+0.05e0*count(*)),2) as confidence from o_reports group by 1,2,3,4""")


@query("agg13_report_outcome", f"select {KEYS}, n as n_reports, outcome as reported_outcome, confidence as report_confidence from o_rep_sum")
def _(b: Bound) -> DataFrame:
    return report_rollup(b.reports).select(*KEY, "n_reports", "reported_outcome", "report_confidence")


@query("joi11_reports_for_service", """
select s.service_id, coalesce(r.n,0) as n_reports, r.outcome as reported_outcome from o_records s
left join o_rep_sum r using (route, origin, service_date, depart_hhmm)""")
def _(b: Bound) -> DataFrame:
    return reports_for_services(b.records, b.reports).select(
        "service_id", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "reported_outcome"
    )


@query("agg26_reported_departures", f"""
select {KEYS}, list_sort(list(departed_at))[count(*)//2+1] as reported_departed_at from o_reports where departed_at is not null group by 1,2,3,4""")
def _(b: Bound) -> DataFrame:
    return reported_departures(b.reports)


@query("agg27_report_summary", f"""
select {KEYS}, count(*) as n, count(*) filter (boarded) as boarded, count(*) filter (not boarded) as left_behind,
 min(strftime(joined_at,'%H:%M')) filter (not boarded) as cutoff_before, max(strftime(joined_at,'%H:%M')) filter (boarded) as still_room_at,
 (list_sort(list(late) filter (late is not null)))[count(late)//2+1] as typical_minutes_late from (
 select *, cast(floor(epoch(departed_at-scheduled)/60) as int) as late from o_reports) group by 1,2,3,4""")
def _(b: Bound) -> DataFrame:
    return report_summary(b.reports, b.params).drop("outcome")


# Reports of every order, submitted at spread-out times, some for slots, sources and decks that do not exist.
shape("o_sub", """
select report_id, route, case when l_partkey%23=0 then 'Z' else origin end as origin, service_date,
 case when l_partkey%19=0 then '03:33' else depart_hhmm end as depart_hhmm, boarded or l_partkey%29=0 as boarded,
 case when l_partkey%31=0 then 3 else sailings_waited end as sailings_waited, joined_at - to_minutes(case when l_partkey%37=0 then 700 else 0 end) as joined_at,
 departed_at + to_minutes(case when l_partkey%17=0 then 190 else 0 end) as departed_at,
 case l_partkey%7 when 0 then 'room' when 1 then 'full' when 2 then 'packed' end as deck_fullness,
 case l_partkey%5 when 0 then 'checkin' when 1 then 'email' else 'web' end as source,
 scheduled + to_minutes(l_partkey%400-20) as submitted_at from o_reports""")


@query("prj08_report_validation", """
select report_id, coalesce(reason, case when row_number() over (partition by route, origin, service_date, depart_hhmm, reason is null order by submitted_at, report_id) > 50 then 'service is full' end) as reason, kept_departed_at
from (select s.*, coalesce(s.departed_at, p.departed_at) as kept_departed_at, case
  when s.origin not in ('A','B') then 'unknown terminal' when t.route is null then 'not in timetable'
  when deck_fullness not in ('room','half','nearly_full','full') then 'unknown deck fullness' when source not in ('web','checkin') then 'unknown source'
  when s.sched > submitted_at then 'not departed yet' when abs(epoch(s.departed_at-s.sched))>10800 then 'departure too far from schedule'
  when sailings_waited is not null and boarded then 'waited while boarded' when sailings_waited not in (1,2) then 'bad wait'
  when joined_at > coalesce(s.departed_at, p.departed_at, s.sched) then 'joined after departure'
  when coalesce(s.departed_at, p.departed_at, s.sched) - joined_at > interval 12 hour then 'joined too early' end as reason
 from (select *, service_date + cast(depart_hhmm||':00' as time) as sched from o_sub) s
 left join (select distinct route, origin, service_date, depart_hhmm from o_records) t using (route, origin, service_date, depart_hhmm)
 left join (select route, origin, service_date, depart_hhmm, max(departed_at) as departed_at from o_records where departed_at is not null group by 1,2,3,4) p using (route, origin, service_date, depart_hhmm))""")
def _(b: Bound) -> DataFrame:
    k = F.col("l_partkey")
    sent = b.reports.select(
        "report_id", "route", F.when(k % 23 == 0, "Z").otherwise(F.col("origin")).alias("origin"), "service_date",
        F.when(k % 19 == 0, "03:33").otherwise(F.col("depart_hhmm")).alias("depart_hhmm"),
        (F.col("boarded") | (k % 29 == 0)).alias("boarded"),
        F.when(k % 31 == 0, 3).otherwise(F.col("sailings_waited")).alias("sailings_waited"),
        add_minutes(F.col("joined_at"), F.when(k % 37 == 0, -700).otherwise(0)).alias("joined_at"),
        add_minutes(F.col("departed_at"), F.when(k % 17 == 0, 190).otherwise(0)).alias("departed_at"),
        F.when(k % 7 == 0, "room").when(k % 7 == 1, "full").when(k % 7 == 2, "packed").alias("deck_fullness"),
        F.when(k % 5 == 0, "checkin").when(k % 5 == 1, "email").otherwise("web").alias("source"),
        add_minutes(F.col("scheduled"), k % 400 - 20).alias("submitted_at"),
    )
    services = b.records.select(*KEY).distinct()
    terminals = services.select("route", F.col("origin").alias("terminal")).distinct()
    published = (
        b.records.filter("departed_at is not null")
        .groupBy("route", F.col("origin").alias("terminal"), "service_date", F.col("depart_hhmm").alias("hhmm"))
        .agg(F.max("departed_at").alias("departed_at"))
    )
    return validate_reports(sent, services, terminals, published, b.params).select(
        "report_id", "reason", "kept_departed_at"
    )


# ---- the merged record ------------------------------------------------------------------
shape("o_judged", f"""
select t.origin, t.service_date, t.depart_hhmm, t.scheduled, t.departed_at, t.departed_source, t.deck_space_min, t.left_full, t.deck, t.deck_filled_at, t.deck_confidence,
 c.* exclude (origin, service_date, depart_hhmm), r.outcome as reported, r.confidence as rep_conf,
 case when coalesce(n_banded,0)>0 then case when residual_band is null or band_at_departure is null or still then 'unknown'
   when residual_band='empty' then case when t.origin='B' and not {SEEN} then 'unknown' else 'boarded' end
   when not {SEEN} then case when t.origin='A' then 'cancelled' else 'unknown' end when band_when_left='empty' then 'boarded' else 'filled' end
  else case when residual_queue is null or queue_at_departure is null or still then 'unknown' when residual_queue<5 then 'boarded'
   when not {SEEN} then case when t.origin='A' then 'cancelled' else 'unknown' end when residual_queue>125 then 'waited_2plus' else 'waited_1' end end as camera
from {JOINED} left join o_told r on r.origin=t.origin and r.service_date=t.service_date and r.depart_hhmm=t.depart_hhmm""")
# The merge, one source after another, each a step over the last.
shape("o_merge1", """
select *, camera in ('waited_1','waited_2plus','filled') or null as f1, case when camera in ('waited_1','waited_2plus','filled') then true when camera='boarded' then false end as l1,
 case when camera in ('waited_1','waited_2plus') then camera end as w1, camera='cancelled' as c1 from o_judged""")
shape("o_merge2", """
select *, case when left_full then true when deck='filled' then true when deck='boarded' and f1 is null then false else f1 end as f2, c1 or deck='cancelled' as c2,
 case when camera='unknown' and (deck<>'unknown' or coalesce(left_full,false)) then coalesce(deck_confidence,0.7e0) else case when coalesce(n_banded,0)>0 then band_conf else count_conf end end as conf2,
 case when camera='unknown' and (deck<>'unknown' or coalesce(left_full,false)) then 'deck_space' else 'frames:'||coalesce(case when coalesce(n_banded,0)>0 then band_src else count_src end,'none') end as m2 from o_merge1""")
shape("o_merge3", """
select *, case when reported is null then c2 else false end as c3, case when reported in ('filled','waited_1','waited_2plus') then true else f2 end as f3,
 case when reported='boarded' then coalesce(l1,false) when reported is not null then true else l1 end as l3,
 case when reported in ('filled','waited_1','waited_2plus') then nullif(reported,'filled') else w1 end as w3,
 case when reported is not null then rep_conf else conf2 end as conf3, case when reported is not null then 'report' else m2 end as m3 from o_merge2""")
shape("o_final", """
select 'r1' as route, origin, service_date, depart_hhmm, scheduled, case when c3 then 'cancelled' when w3 is not null then w3 when f3 then 'filled' when f3=false or l3=false then 'boarded' else 'unknown' end as outcome,
 case when not c3 then f3 end as filled, case when not c3 then l3 end as left_behind, c3 as cancelled, coalesce(case when not c3 then l3 end,false) as overload,
 peak_queue, queue_at_departure, residual_queue,
 case when coalesce(n_banded,0)>0 then case when camera='boarded' then 0 end when camera='boarded' then 0 when camera<>'unknown' then residual_queue end as carryover,
 coalesce(n_frames,0) as n_frames, conf3 as confidence, coalesce(truncated,false) as queue_truncated, deck_space_min, m3 as method,
 coalesce(deck_filled_at, case when not c3 and f3 then fill_mark end) as filled_at, ['empty','light','moderate','heavy','overflowing'][peak_rank] as peak_band,
 band_at_departure, residual_band, queue_started_at, cleared_at, left_full, departed_at, departed_source from o_merge3""")

RECORD = (
    "outcome filled left_behind cancelled overload peak_queue queue_at_departure residual_queue carryover n_frames "
    "confidence queue_truncated deck_space_min method filled_at peak_band band_at_departure residual_band "
    "queue_started_at cleared_at left_full departed_at departed_source"
).split()


@query("agg14_service_record", f"select {KEYS}, {', '.join(RECORD)} from o_final")
def _(b: Bound) -> DataFrame:
    return service_records(b.services, _evidence(b), b.params).select(*KEY, *RECORD)


@query("agg15_outcome_totals", """
select route, date_trunc('month', service_date)::date as month, count(*) filter (outcome='boarded') as boarded, count(*) filter (outcome='waited_1') as waited_1,
 count(*) filter (outcome='waited_2plus') as waited_2plus, count(*) filter (outcome='filled') as filled, count(*) filter (outcome='cancelled') as cancelled, count(*) filter (outcome='unknown') as unknown
from o_records group by 1,2""")
def _(b: Bound) -> DataFrame:
    return outcome_totals(b.records, ["route", F.trunc("service_date", "month").alias("month")])


@query("agg18_tags_per_date", """
select d as service_date, coalesce(string_agg(tag, '|' order by tag), '') as tags from (
 select o_cal.d, x.tag from o_cal left join (
  select d, 'holiday:'||holiday as tag from o_cal where holiday is not null union select d, 'long_weekend' from o_cal where long_weekend
  union select cast(ts as date), 'event:'||event_type from {events} where value>95) x on x.d=o_cal.d) group by 1""")
def _(b: Bound) -> DataFrame:
    dates = b.event_days.union(b.table("orders").select(F.to_date("o_orderdate").alias("service_date")))
    manual = b.table("events").filter("value > 95").select(
        F.to_date("ts").alias("service_date"), F.concat(F.lit("event:"), "event_type").alias("tag")
    )
    return tags_per_date(dates, manual).select("service_date", F.array_join("tags", "|").alias("tags"))
