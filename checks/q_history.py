"""Comparable history, curves, live boards and what to read next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.q_evidence import KEY, KEYS
from checks.registry import query
from checks.views import SHAPES, shape
from tidewait.functions.clock import combine_local
from tidewait.operators import cohort, curve, fill, ledger, live
from tidewait.operators import board as brd
from tidewait.operators.reports import report_bounds
from tidewait.params import REPORTED_OUTCOMES, Params

SLOT = "route, origin, depart_hhmm, day_type, season, long_weekend"

# ---- QRY-01..06 -------------------------------------------------------------------------
# Every target against every candidate, rung by rung, with no shortcut.
shape("o_targets", f"select distinct {KEYS}, day_type, season, long_weekend, minutes from o_records")
shape("o_partner", "select * from (values ('weekday','friday'),('friday','weekday'),('saturday','sunday_holiday'),('sunday_holiday','saturday')) p(day_type, partner)")


def ladder(prefix: str, targets: str, records: str) -> None:
    # A record's place in the order of the matches: one number is compared instead of three columns.
    shape(f"o_{prefix}_ranked", f"select *, row_number() over (order by service_date, scheduled, service_id) as rk from {records}")
    # Targets of one slot differ only in the date they leave out, so each slot keeps its newest six dates of each rung.
    slot = "route, origin, day_type, season, long_weekend, minutes"
    shape(f"o_{prefix}_hits", f"""
select * from (select {', '.join('t.' + c for c in slot.split(', '))}, greatest(
  case when c.day_type=t.day_type then 0 else 5 end, case when c.long_weekend=t.long_weekend then 0 else 4 end,
  case when abs(c.minutes-t.minutes)<=15 then 0 else 3 end, case when c.season=t.season then 0 else 2 end, 1) as rung, c.service_date as d, max(c.rk, 5) as best
from (select distinct {slot} from {targets}) t join o_partner p on p.day_type=t.day_type join o_{prefix}_ranked c on c.route=t.route and c.origin=t.origin
 and c.day_type in (t.day_type, p.partner) and abs(c.minutes-t.minutes)<=60 and c.outcome<>'unknown' group by all)
qualify row_number() over (partition by {slot}, rung order by d desc) <= 6""")
    shape(f"o_{prefix}_tops", f"""
select {KEYS}, r, list_slice(list_reverse_sort(flatten(list(best))), 1, 5) as tops from {targets} t join o_{prefix}_hits h using ({slot})
 join (select unnest([1,2,3,4,5]) as r) on rung<=r where d<>service_date group by {KEYS}, r""")
    shape(f"o_{prefix}_used", f"""
select t.*, coalesce(u.r, 5) as rung, coalesce(x.tops, []) as tops from {targets} t
left join (select {KEYS}, min(r) as r from o_{prefix}_tops where len(tops)>=5 group by all) u using ({KEYS})
left join o_{prefix}_tops x on x.route=t.route and x.origin=t.origin and x.service_date=t.service_date and x.depart_hhmm=t.depart_hhmm and x.r=coalesce(u.r,5)""")
    shape(f"o_{prefix}_listed", f"""
select u.*, c.service_id, c.scheduled as m_scheduled, c.service_date as m_date, c.depart_hhmm as m_hhmm, c.outcome, c.left_full, c.filled_at,
 case when c.filled is null and c.left_behind is null then case when outcome in ('waited_1','waited_2plus','filled') then true when outcome='boarded' then false end else c.filled end as ef,
 case when c.filled is null and c.left_behind is null then case when outcome in ('waited_1','waited_2plus') then true when outcome='boarded' then false end else c.left_behind end as el,
 case when c.filled_at is not null then cast(greatest(floor(epoch(c.scheduled-c.filled_at)/60),0) as int) end as gap,
 case when method like 'frames%' then 'frames' when method like 'report%' then 'report' when method like 'import%' then 'import' when method like 'deck_space%' then 'deck_space' end as kind
from (select {KEYS}, rung, unnest(tops) as sid, generate_subscripts(tops,1) as place from o_{prefix}_used) u join o_{prefix}_ranked c on c.rk=u.sid""")
    shape(f"o_{prefix}_tally", f"""
select {KEYS}, count(*) as n, count(*) filter (outcome='boarded') as n_boarded, count(*) filter (outcome='filled') as n_filled, count(*) filter (outcome='waited_1') as n_waited_1,
 count(*) filter (outcome='waited_2plus') as n_waited_2plus, count(*) filter (outcome='cancelled') as n_cancelled,
 count(*) filter (outcome<>'cancelled' and not coalesce(ef,false)) as had_space, count(*) filter (outcome<>'cancelled' and ef) as filled_count, count(*) filter (outcome='cancelled') as cancelled_count,
 count(*) filter (outcome<>'cancelled' and ef and el) as left_behind_count, count(*) filter (outcome<>'cancelled' and ef and not el) as took_everyone, count(*) filter (outcome<>'cancelled' and ef and el is null) as unresolved,
 count(*) filter (left_full is not null) as board_reported, count(*) filter (left_full is not null and kind in ('frames','report')) as sharpened,
 (list_sort(list(gap) filter (gap is not null)))[count(gap)//2+1] as fill_minutes_before,
 case count(distinct kind) when 0 then 'unknown' when 1 then max(kind) else 'mixed' end as evidence
from o_{prefix}_listed group by {KEYS}""")
    shape(f"o_{prefix}", f"""
select u.* exclude (tops), coalesce(n,0) as n, {', '.join(f'coalesce({c},0) as {c}' for c in (*[f'n_{o}' for o in REPORTED_OUTCOMES], 'had_space', 'filled_count', 'cancelled_count', 'left_behind_count', 'took_everyone', 'unresolved', 'board_reported', 'sharpened'))},
 fill_minutes_before, coalesce(evidence,'unknown') as evidence, coalesce(n,0)>=5 as sufficient, ['exact','any_season','wider_time','any_long_weekend','grouped_days'][rung] as match_level,
 strftime(timestamp '2000-01-01' + to_minutes(u.minutes - fill_minutes_before), '%H:%M') as fill_local
from o_{prefix}_used u left join o_{prefix}_tally using ({KEYS})""")


ladder("dist", "o_targets", "o_records")


def _targets(b: Bound) -> DataFrame:
    return b.records.select(*KEY).distinct()


@query("qry01_distribution", f"""
select route, origin, service_date, depart_hhmm, d.day_type, season, n, {', '.join(f'case when n>0 then round(n_{o}/n,4) else 0 end as share_{o}' for o in REPORTED_OUTCOMES)}, match_level, rung, sufficient, evidence, fill_minutes_before, fill_local,
 case when n>0 then round(filled_count/n,4) else 0 end as filled_share,
 array_to_string(list_slice(['widened to all seasons','widened to +/-60 min','widened to include days outside a long weekend, which behave differently','widened to similar day types ('||d.day_type||', '||p.partner||')'], 1, rung-1), '|') as relaxations,
 coalesce(uo.u,0) + case when rung=5 then coalesce(up.u,0) else 0 end as unknown_excluded
from o_dist d join (select day_type as own, partner from o_partner) p on p.own=d.day_type
left join (select route, origin, day_type, count(*) as u from o_records where outcome='unknown' group by all) uo using (route, origin, day_type)
left join (select route, origin, day_type as partner, count(*) as u from o_records where outcome='unknown' group by all) up using (route, origin, partner)""")
def _(b: Bound) -> DataFrame:
    d = cohort.distribution(_targets(b), b.records, b.params)
    return d.select(
        *KEY, "day_type", "season", "n", *[f"share_{o}" for o in REPORTED_OUTCOMES], "match_level", "rung",
        "sufficient", "evidence", "fill_minutes_before", "fill_local", "filled_share",
        F.array_join("relaxations", "|").alias("relaxations"), "unknown_excluded",
    )


@query("qry02_outcome_counts", f"select {KEYS}, n, {', '.join(f'n_{o}' for o in REPORTED_OUTCOMES)} from o_dist")
def _(b: Bound) -> DataFrame:
    d = cohort.distribution(_targets(b), b.records, b.params)
    return d.select(*KEY, "n", *[f"n_{o}" for o in REPORTED_OUTCOMES])


AXES = "had_space filled_count cancelled_count left_behind_count took_everyone unresolved board_reported sharpened".split()


@query("qry03_axis_counts", f"select {KEYS}, {', '.join(AXES)} from o_dist")
def _(b: Bound) -> DataFrame:
    return cohort.distribution(_targets(b), b.records, b.params).select(*KEY, *AXES)


@query("qry04_typical_fill", f"select {KEYS}, fill_minutes_before, fill_local from o_dist")
def _(b: Bound) -> DataFrame:
    return cohort.distribution(_targets(b), b.records, b.params).select(*KEY, "fill_minutes_before", "fill_local")


@query("qry05_samples", f"""
select {KEYS}, place, service_id as sample_id, m_date as sample_date, m_hhmm as sample_hhmm, outcome, ef as filled, el as left_behind, left_full,
 strftime(filled_at,'%H:%M') as filled_at_local, gap as fill_minutes_before, coalesce(kind,'unknown') as evidence, r.day_type as sample_day_type, r.season as sample_season, [cast(m_date as varchar)[6:7]] as tags
from o_dist_listed left join (select service_id, day_type, season from o_records) r using (service_id)""")
def _(b: Bound) -> DataFrame:
    tags = b.records.select("service_date", F.date_format("service_date", "MM").alias("tag"))
    keep = [*KEY, "place", "sample_id", "sample_date", "sample_hhmm", "outcome", "filled", "left_behind", "left_full", "filled_at_local", "fill_minutes_before", "evidence", "sample_day_type", "sample_season", "tags"]
    return cohort.samples(_targets(b), b.records, b.params, tags).select(*keep)


shape("o_dayboard", """
select *, case when n>0 then round(n_boarded/n,4) else 0 end as boarded_share, case when n>0 then round(filled_count/n,4) else 0 end as filled_share, n>0 and rung>1 as relaxed from o_dist""")


@query("qry06_day_board", f"""
select {KEYS}, n, {', '.join(f'n_{o}' for o in REPORTED_OUTCOMES)}, boarded_share, filled_share, sufficient, match_level, relaxed, fill_local as arrive_by, fill_minutes_before,
 case when not sufficient or n=0 then '' when boarded_share>=0.7 then 'room most days' when boarded_share>=0.45 then 'toss-up' else 'expect to wait' end as outlook from o_dayboard""")
def _(b: Bound) -> DataFrame:
    rows = cohort.day_board(_targets(b), b.records, b.params)
    return rows.select(
        *KEY, "n", *[f"n_{o}" for o in REPORTED_OUTCOMES], "boarded_share", "filled_share", "sufficient",
        "match_level", "relaxed", "arrive_by", "fill_minutes_before", "outlook",
    )


@query("joi12_records_join", """
select service_id, route, origin, service_date, depart_hhmm, outcome from o_records where outcome<>'unknown' and day_type in ('friday','weekday')
 and season='shoulder' and service_date<>date '1998-10-03'""")
def _(b: Bound) -> DataFrame:
    day = F.lit("1998-10-03").cast("date")
    found = cohort.known_records(b.records, ["friday", "weekday"], "shoulder", day)
    return found.select("service_id", *KEY, "outcome")


@query("agg29_unknown_count", "select route, origin, day_type, count(*) as unknown from o_records where outcome='unknown' group by all")
def _(b: Bound) -> DataFrame:
    return cohort.unknown_counts(b.records)


# ---- report bounds and collection -------------------------------------------------------
shape("o_leads", """
select r.*, c.day_type, c.long_weekend, cast(floor(epoch(scheduled-joined_at)/60) as int) as lead,
 cast(split_part(depart_hhmm,':',1) as int)*60+cast(split_part(depart_hhmm,':',2) as int) as minutes
from o_reports r join o_cal c on c.d=r.service_date where joined_at < scheduled and floor(epoch(scheduled-joined_at)/60)>0""")


# One row per report would meet every target of its pool, so the check folds each date first.
shape("o_lead_dates", """
select route, origin, day_type, long_weekend, depart_hhmm, minutes, service_date, max(lead) filter (not boarded) as f, min(lead) filter (boarded) as g,
 count(*) filter (boarded) as nb, count(*) filter (not boarded) as nm from o_leads group by all""")
shape("o_bounds", """
select t.route, t.origin, t.service_date, t.depart_hhmm, t.minutes, t.fill_minutes_before, max((l.f, l.service_date, l.depart_hhmm)) filter (l.f is not null) as best,
 min(l.g) as low, sum(nb) as nb, sum(nm) as nm, count(*) as nd, count(*) filter (nm>0) as nmd
from (select *, case when minutes%2=0 then 20 end as fill_minutes_before from o_targets) t join o_lead_dates l on l.route=t.route and l.origin=t.origin and l.day_type=t.day_type and l.long_weekend=t.long_weekend
 and abs(l.minutes-t.minutes)<=15 and l.service_date<>t.service_date group by all""")


@query("qry08_report_bounds", f"""
select {KEYS}, case when tight then strftime(timestamp '2000-01-01' + to_minutes(minutes-best[1]), '%H:%M') end as turned_away_at, case when tight then best[1] end as turned_away_minutes_before,
 case when tight then best[2] end as turned_away_date, cast(nmd as bigint) as turned_away_sailings, strftime(timestamp '2000-01-01' + to_minutes(minutes-got), '%H:%M') as boarded_by, got as boarded_by_minutes_before,
 cast(nd as bigint) as n_sailings, cast(nb+nm as bigint) as n_reports
from (select *, best is not null and (fill_minutes_before is null or best[1]>fill_minutes_before) as tight, case when nb>=2 then low end as got from o_bounds) where tight or got is not null""")
def _(b: Bound) -> DataFrame:
    minutes = F.substring("depart_hhmm", 4, 2).cast("int")
    targets = _targets(b).withColumn("fill_minutes_before", F.when(minutes % 2 == 0, 20))
    return report_bounds(targets, b.reports, b.params)


shape("o_status_pool", """
select t.route, t.origin, t.day_type, t.depart_hhmm as target_hhmm, c.* exclude (route, origin, day_type)
from (select distinct route, origin, day_type, depart_hhmm, minutes from o_targets) t join o_records c on c.route=t.route and c.origin=t.origin and c.day_type=t.day_type and abs(c.minutes-t.minutes)<=15""")


@query("qry09_collection_status", """
select s.route, s.origin, s.day_type, target_hhmm, place, service_id, s.service_date, s.depart_hhmm, outcome, strftime(coalesce(s.departed_at, d.at),'%H:%M') as departed_local,
 coalesce(departed_source, case when d.at is not null then 'report' end) as departed_source, cast(floor(epoch(coalesce(s.departed_at, d.at)-scheduled)/60) as int) as minutes_late,
 strftime(filled_at,'%H:%M') as filled_at_local, case when method like 'frames%' then 'frames' when method like 'report%' then 'report' when method like 'import%' then 'import' when method like 'deck_space%' then 'deck_space' else 'unknown' end as evidence,
 t.recorded, t.unknown, t.timed, t.since
from (select *, row_number() over (partition by route, origin, day_type, target_hhmm order by scheduled desc, service_id desc) as place from o_status_pool where outcome<>'unknown' or departed_at is not null) s
join (select route, origin, day_type, target_hhmm, count(*) filter (outcome<>'unknown') as recorded, count(*) filter (outcome='unknown') as unknown, count(departed_at) as timed, min(service_date) as since from o_status_pool group by all) t using (route, origin, day_type, target_hhmm)
left join (select route, origin, service_date, depart_hhmm, list_sort(list(departed_at))[count(*)//2+1] as at from o_reports where departed_at is not null group by all) d
 on d.route=s.route and d.origin=s.origin and d.service_date=s.service_date and d.depart_hhmm=s.depart_hhmm
where place<=6""")
def _(b: Bound) -> DataFrame:
    totals, listed = cohort.collection_status(_targets(b), b.records, b.reports, b.params)
    return listed.join(totals, ["route", "origin", "day_type", "target_hhmm"])


# ---- curves: services with the board's verdict as their outcome --------------------------
shape("o_known", """
select s.*, cast(split_part(s.depart_hhmm,':',1) as int)*60+cast(split_part(s.depart_hhmm,':',2) as int) as minutes
from o_services s join o_board_class b using (origin, service_date, depart_hhmm) where b.outcome<>'unknown'""")
shape("o_curve_t", """
select distinct s.route, s.origin, s.day_type, s.season, s.depart_hhmm, cast(split_part(s.depart_hhmm,':',1) as int)*60+cast(split_part(s.depart_hhmm,':',2) as int) as minutes, p.partner
from o_services s join o_partner p using (day_type)""")
shape("o_curve_pool", """
select * from (select t.depart_hhmm as t_hhmm, t.day_type as t_type, t.season as t_season, c.*, count(*) filter (c.season=t.season) over (partition by t.route, t.origin, t.depart_hhmm, t.day_type, t.season) as same
 from o_curve_t t join o_known c on c.route=t.route and c.origin=t.origin and c.day_type in (t.day_type, t.partner) and abs(c.minutes-t.minutes)<=15)
where same<5 or season=t_season""")
shape("o_curve_v", """
select p.route, p.origin, t_hhmm, t_type, t_season, 1 as o, 'lanes' as source, cast(floor(epoch(scheduled-f.captured_at)/60) as int) as mb, lanes_occupied as v
from o_curve_pool p join o_usable f on f.terminal=p.origin and f.captured_at between scheduled - interval 120 minute and scheduled where version='lane' and lanes_occupied is not null
union all select p.route, p.origin, t_hhmm, t_type, t_season, 2, 'frames', cast(floor(epoch(scheduled-f.captured_at)/60) as int), vehicle_count
from o_curve_pool p join o_usable f on f.terminal=p.origin and f.captured_at between scheduled - interval 120 minute and scheduled where vehicle_count is not null
union all select p.route, p.origin, t_hhmm, t_type, t_season, 3, 'deck_space', cast(floor(epoch(p.scheduled-b.observed_at)/60) as int), percent_available
from o_curve_pool p join o_board b on b.terminal=p.origin and b.service_date=p.service_date and b.hhmm=p.depart_hhmm where percent_available is not null and fetch_status='ok'
 and floor(epoch(p.scheduled-b.observed_at)/60) between 0 and 120""")


def _known_services(b: Bound) -> DataFrame:
    verdict = brd.board_summary(b.board, b.params).select(
        "route", F.col("terminal").alias("origin"), "service_date", F.col("hhmm").alias("depart_hhmm"), "deck_outcome"
    )
    return b.services.join(verdict, KEY).filter("deck_outcome <> 'unknown'")


@query("qry07_arrival_curve", """
select route, origin, t_hhmm as depart_hhmm, t_type as day_type, t_season as season, sailings, source, mb//15*15 as minutes_before, count(*) as n, max(v) as max,
 list_sort(list(v))[cast(round_even(0.5*(count(*)-1),0) as int)+1] as median,
 list_sort(list(v))[cast(round_even(case when source='deck_space' then 0.75 else 0.25 end*(count(*)-1),0) as int)+1] as p25,
 list_sort(list(v))[cast(round_even(case when source='deck_space' then 0.25 else 0.75 end*(count(*)-1),0) as int)+1] as p75
from (select *, min(o) over (partition by route, origin, t_hhmm, t_type, t_season) as best from o_curve_v)
join (select route, origin, t_hhmm, t_type, t_season, count(*) as sailings from o_curve_pool group by all) using (route, origin, t_hhmm, t_type, t_season)
where o=best group by route, origin, t_hhmm, t_type, t_season, sailings, source, mb//15*15""")
def _(b: Bound) -> DataFrame:
    return curve.arrival_curve(b.services, _known_services(b), b.readings, b.board, b.params)


@query("win12_previous_departure_offset", """
select route, origin, t_hhmm as depart_hhmm, t_type as day_type, t_season as season, count(*) as sailings,
 case when count(gap)>0 and count(gap)*2>=count(*) and max(gap)-min(gap)<=15 then
  case when (list_sort(list(gap) filter (gap is not null)))[cast(round_even(0.5*(count(gap)-1),0) as int)+1] < 165 then (list_sort(list(gap) filter (gap is not null)))[cast(round_even(0.5*(count(gap)-1),0) as int)+1] end end as previous_departure_minutes
from (select p.*, cast(epoch(p.scheduled-n.prev_dep)/60 as int) as gap from o_curve_pool p join o_neigh n using (origin, service_date, depart_hhmm)) group by 1,2,3,4,5""")
def _(b: Bound) -> DataFrame:
    return curve.previous_departure_offset(b.services, _known_services(b), b.services, b.params)


# ---- ledger -----------------------------------------------------------------------------
def _ledger(b: Bound) -> DataFrame:
    return ledger.departure_ledger(b.positions, b.board, b.terminals, b.params)


def _anchored(b: Bound) -> DataFrame:
    days = ledger.ledger_days(b.positions, b.terminals, b.params)
    return ledger.anchor_match(ledger.day_moments(days), b.board, b.params)


@query("win02_transitions", "select d as ledger_date, moment, position from o_moments")
def _(b: Bound) -> DataFrame:
    days = ledger.ledger_days(b.positions, b.terminals, b.params)
    return ledger.day_moments(days).select("ledger_date", "moment", "position")


@query("joi09_anchor_match", "select d as ledger_date, position, moment, anchor from o_anchored")
def _(b: Bound) -> DataFrame:
    return _anchored(b).select("ledger_date", "position", "moment", "anchor")


@query("win03_ledger_breaks", "select d as ledger_date, position, segment from o_segments")
def _(b: Bound) -> DataFrame:
    return ledger.ledger_segments(_anchored(b), b.params).select("ledger_date", "position", "segment")


@query("win04_alternation_labels", "select d as ledger_date, position, moment, terminal from o_ledger")
def _(b: Bound) -> DataFrame:
    return _ledger(b).select("ledger_date", "position", "moment", "terminal")


@query("joi10_pair_departures", "select origin, service_date, depart_hhmm, tracked_at from o_tracked")
def _(b: Bound) -> DataFrame:
    paired = ledger.tracked_departures(b.services, _ledger(b), b.params)
    return paired.select("origin", "service_date", "depart_hhmm", "tracked_at")


# Every date is looked at once, at ten past three.
def _at(day: Column) -> Column:
    return combine_local(day, F.lit("15:10"), "UTC")


NOW = "(s.service_date + time '15:10:00')"
# The ledger at that moment: the shapes above over what had been reported by then.
STEPS = ("pos", "moving", "moments", "anchored", "breaks", "segments", "ledger", "left", "walk")
for name in STEPS:
    text = SHAPES[f"o_{name}"]
    for other in STEPS:
        text = re.sub(rf"\bo_{other}\b", f"o_by_{other}", text)
    if name == "pos":
        text = f"select * from ({text}) where cast(reported_at as time) <= time '15:10:00'"
    shape(f"o_by_{name}", text)
shape("o_watch", f"""
select s.*, w.tracked_at, f.at as tracker_at, case when s.scheduled <= {NOW} and f.at is not null and not coalesce(x.nameless, false) then
  case when w.tracked_at <= {NOW} then 'departed' when {NOW} <= s.scheduled + interval 75 minute then 'not_away' end end as tracker_state
from o_services s left join (select cast(reported_at as date) as d, max(reported_at) as at from o_by_pos group by 1) f on f.d=s.service_date
left join (select d, count(terminal)=0 as nameless from o_by_ledger group by 1) x on x.d=s.service_date
left join (select * from o_by_walk where tracked_at is not null) w on w.origin=s.origin and w.service_date=s.service_date and w.depart_hhmm=s.depart_hhmm""")


@query("win05_tracker_watch", f"select {KEYS}, tracked_at, tracker_at, tracker_state from o_watch")
def _(b: Bound) -> DataFrame:
    watch = ledger.tracker_watch(b.services, b.positions, b.board, b.terminals, _at, b.params)
    return watch.select(*KEY, "tracked_at", "tracker_at", "tracker_state")


# Polls are sparse here, so a board counts as fresh for two hours.
LIVE = Params(zone="UTC", poll_minutes=60, tracker_fresh_minutes=90)
shape("o_scrape", """
select *, max(last_seen) over (partition by terminal, service_date) as board_at from (
 select terminal, service_date, hhmm, arg_max(departed_hhmm, (observed_at,row_id)) filter (departed_hhmm is not null) as dep, max(observed_at) as last_seen
 from o_board where fetch_status='ok' and cast(observed_at as time) <= time '15:10:00' group by all)""")
shape("o_held", f"""
select s.*, s.scheduled <= {NOW} as past, s.scheduled <= {NOW} and gone as sailed, s.scheduled <= {NOW} and not gone as holding from (
 select s.*, case when coalesce(a.board_at >= {NOW} - interval 120 minute, false) then b.dep is not null or coalesce(b.last_seen,timestamp '1900-01-01') <> a.board_at
   or coalesce(s.tracker_state='departed' and s.tracker_at >= {NOW} - interval 90 minute, false)
  else not coalesce(s.tracker_state='not_away' and s.tracker_at >= {NOW} - interval 90 minute, false) end as gone
 from o_watch s left join o_scrape b on b.terminal=s.origin and b.service_date=s.service_date and b.hhmm=s.depart_hhmm
 left join (select terminal, service_date, max(board_at) as board_at from o_scrape group by 1,2) a on a.terminal=s.origin and a.service_date=s.service_date) s""")


@query("prj07_holding_resolution", f"select {KEYS}, past, sailed, holding from o_held")
def _(b: Bound) -> DataFrame:
    held = live.holding_resolution(b.services, b.board, b.positions, b.terminals, _at, LIVE)
    return held.select(*KEY, "past", "sailed", "holding")


# ---- the day board read as a day --------------------------------------------------------
shape("o_answer", "select *, sufficient and n>0 as known from o_dayboard")


@query("win11_worst_of_day", """
select route, origin, service_date, arg_min(depart_hhmm, boarded_share) as worst_hhmm, min(boarded_share) as boarded_share, count(*) as answerable from o_answer a where known group by 1,2,3
having count(*)>=2 and min(boarded_share)<0.45 and len(list_filter(list(boarded_share), lambda x: x=list_min(list(boarded_share))))=1""".replace(
    "len(list_filter(list(boarded_share), lambda x: x=list_min(list(boarded_share))))=1",
    "(list_sort(list(boarded_share)))[1] < (list_sort(list(boarded_share)))[2]",
))
def _(b: Bound) -> DataFrame:
    rows = cohort.day_board(_targets(b), b.records, b.params)
    return live.worst_of_day(rows, b.params)


shape("o_flags", """
select *, known and boarded_share>=0.7 as easy, known and boarded_share<0.45 as hard, row_number() over w as i, count(*) over (partition by route, origin, service_date) as len
from o_answer window w as (partition by route, origin, service_date order by depart_hhmm)""")
shape("o_runs", """
select route, origin, service_date, min(i) as a, max(i) as z, count(*) as len, min(depart_hhmm) as h0, max(depart_hhmm) as h1 from (
 select *, i - row_number() over (partition by route, origin, service_date order by i) as isl from o_flags where hard) group by route, origin, service_date, isl""")


@query("win10_day_shape", """
select f.route, f.origin, f.service_date, f.services, f.answerable, coalesce(nullif(concat_ws(', ', case when first_easy and other0 is not null then 'before '||other0 end, case when last_easy and other1 is not null then 'after '||other1 end),''), easy_list) as easiest,
 case when r.longest>1 then r.h0||'–'||r.h1 when r.runs=1 then r.h0 end as hardest
from (select route, origin, service_date, count(*) as services, count(*) filter (known) as answerable, bool_or(easy) filter (i=1) as first_easy, bool_or(easy) filter (i=len) as last_easy,
  min(depart_hhmm) filter (not easy) as other0, max(depart_hhmm) filter (not easy) as other1, string_agg(depart_hhmm, ', ' order by i) filter (easy) as easy_list from o_flags group by 1,2,3) f
left join (select route, origin, service_date, count(*) as runs, max(len) as longest, arg_max(h0, (len,-a)) as h0, arg_max(h1, (len,-a)) as h1 from o_runs group by 1,2,3) r using (route, origin, service_date)
where answerable>=3 and answerable*2>=services""")
def _(b: Bound) -> DataFrame:
    rows = cohort.day_board(_targets(b), b.records, b.params)
    return live.day_shape(rows, b.params)


# The month's timetable answered from the orders' history.
shape("o_live_t", """
select route, origin, service_date, depart_hhmm, day_type, season, long_weekend, cast(split_part(depart_hhmm,':',1) as int)*60+cast(split_part(depart_hhmm,':',2) as int) as minutes from o_services""")
ladder("live", "o_live_t", "o_records")
shape("o_live_rows", "select *, sufficient and n>0 as known, case when n>0 then round(n_boarded/n,4) else 0 end as boarded_share from o_live")
shape("o_live_worst", """
select route, origin, service_date, arg_min(depart_hhmm, boarded_share) as worst from o_live_rows where known group by 1,2,3
having count(*)>=2 and min(boarded_share)<0.45 and (list_sort(list(boarded_share)))[1] < (list_sort(list(boarded_share)))[2]""")


@query("win13_live_service_status", f"""
select s.route, s.origin, s.service_date, s.depart_hhmm, case when sailed then 'departed' when holding then 'holding'
 when s.scheduled = min(case when s.scheduled >= {NOW} then s.scheduled end) over d then 'next' when s.depart_hhmm = w.worst then 'worst' when s.scheduled = max(s.scheduled) over d then 'last' else 'plain' end as status,
 r.boarded_share from o_held s join o_live_rows r using (route, origin, service_date, depart_hhmm) left join o_live_worst w using (route, origin, service_date)
window d as (partition by s.route, s.origin, s.service_date)""")
def _(b: Bound) -> DataFrame:
    rows = cohort.day_board(b.services, b.records, LIVE)
    held = live.holding_resolution(b.services, b.board, b.positions, b.terminals, _at, LIVE)
    status = live.live_service_status(rows, held, _at, LIVE)
    return status.select(*KEY, "status", "boarded_share")


# ---- live readings ----------------------------------------------------------------------
AS_OF = "timestamp '2024-01-20 12:00:00'"


def _as_of() -> Column:
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


@query("top07_live_readings", f"""
select terminal, frame_id, captured_at, usable, age_minutes, rank, frame_id = first_value(frame_id) over (partition by terminal order by usable desc, captured_at desc, frame_id desc) as is_latest from (
 select *, cast(floor(epoch({AS_OF}-captured_at)/60) as int) as age_minutes, row_number() over (partition by terminal order by captured_at desc, frame_id desc) as rank from o_readings
 where version='model' and captured_at between {AS_OF} - interval 720 minute and {AS_OF}) qualify rank<=3 or is_latest""")
def _(b: Bound) -> DataFrame:
    wide = Params(zone="UTC", on_demand_age_minutes=720)
    recent = live.live_readings(b.readings, _as_of(), wide).select(
        "terminal", "frame_id", "captured_at", "usable", "age_minutes", "rank"
    )
    latest = live.latest_live_reading(b.readings, _as_of(), wide).select(
        "terminal", "frame_id", "captured_at", "usable", "age_minutes", F.lit(True).alias("is_latest")
    )
    return recent.join(latest, ["terminal", "frame_id", "captured_at", "usable", "age_minutes"], "left").withColumn(
        "is_latest", F.coalesce("is_latest", F.lit(False))
    )


shape("o_next", f"""
select s.* from o_services s where s.scheduled >= {NOW} qualify row_number() over (partition by origin, service_date order by scheduled)=1""")
shape("o_live_bounds", """
select t.route, t.origin, t.service_date, t.depart_hhmm, max(l.lead) filter (not l.boarded) as failed
from (select n.*, cast(split_part(depart_hhmm,':',1) as int)*60+cast(split_part(depart_hhmm,':',2) as int) as minutes from o_next n) t
join o_leads l on l.route=t.route and l.origin=t.origin and l.day_type=t.day_type and l.long_weekend=t.long_weekend and abs(l.minutes-t.minutes)<=15 group by 1,2,3,4""")


@query("qry10_check_and_compare", f"""
select s.route, s.origin, s.service_date, s.depart_hhmm, d.n, d.match_level, d.fill_minutes_before, case when d.fill_minutes_before is null or b.failed>d.fill_minutes_before then b.failed end as turned_away_minutes_before,
 f.frame_id, f.vehicle_count, f.usable, f.age_minutes
from o_next s join o_live d using (route, origin, service_date, depart_hhmm) left join o_live_bounds b using (route, origin, service_date, depart_hhmm)
left join (select terminal, service_date as d0, frame_id, vehicle_count, usable, cast(floor(epoch(service_date + time '15:10:00' - captured_at)/60) as int) as age_minutes from o_readings
 where version='model' and captured_at between service_date + time '13:40:00' and service_date + time '15:10:00'
 qualify row_number() over (partition by terminal, service_date order by usable desc, captured_at desc, frame_id desc)=1) f on f.terminal=s.origin and f.d0=s.service_date""")
def _(b: Bound) -> DataFrame:
    from tidewait.plans.compare import check_and_compare

    answer = check_and_compare(b.services, b.readings, b.records, b.reports, _at, b.params)
    return answer.select(
        *KEY, "n", "match_level", "fill_minutes_before", "turned_away_minutes_before", "frame_id",
        "vehicle_count", "usable", "age_minutes",
    )


# ---- what to read next ------------------------------------------------------------------
shape("o_open", """
select s.*, cast(split_part(s.depart_hhmm,':',1) as int)*60+cast(split_part(s.depart_hhmm,':',2) as int) as minutes from o_services s
left join o_known k using (origin, service_date, depart_hhmm) where k.origin is null and s.service_date < date '2024-01-28'""")
shape("o_fillable", """
select t.route, t.origin, t.day_type, t.season, t.depart_hhmm as target_hhmm, o.service_date, o.depart_hhmm, o.scheduled, row_number() over (partition by t.route, t.origin, t.day_type, t.season, t.depart_hhmm order by o.scheduled desc, o.depart_hhmm desc) as place
from o_curve_t t join o_open o on o.route=t.route and o.origin=t.origin and o.day_type=t.day_type and o.season=t.season and abs(o.minutes-t.minutes)<=15 qualify place<=6""")


def _fillable(b: Bound) -> DataFrame:
    known = _known_services(b).withColumn("outcome", F.col("deck_outcome"))
    today = F.lit("2024-01-28").cast("date")
    return fill.fillable_services(b.services, b.services, known, today, b.params)


@query("joi06_fillable_services", "select route, origin, day_type, season, target_hhmm, service_date, depart_hhmm, place from o_fillable")
def _(b: Bound) -> DataFrame:
    return _fillable(b).select(
        "route", "origin", "day_type", "season", "target_hhmm", "service_date", "depart_hhmm", "place"
    )


shape("o_known_records", """
select row_number() over (order by origin, s.service_date, s.depart_hhmm) as service_id, s.route, origin, s.service_date, s.depart_hhmm, s.scheduled, s.day_type, s.season, s.long_weekend,
 cast(split_part(s.depart_hhmm,':',1) as int)*60+cast(split_part(s.depart_hhmm,':',2) as int) as minutes, b.outcome, 'deck_space' as method, b.left_full,
 cast(null as boolean) as filled, cast(null as boolean) as left_behind, b.filled_at, cast(null as timestamp) as departed_at, cast(null as string) as departed_source
from o_services s join o_board_class b using (origin, service_date, depart_hhmm)""")
ladder("fill", "o_live_t", "o_known_records")
shape("o_unread", "select f.* from o_main f where version<>'model'")
shape("o_unread_near", """
select s.origin, s.service_date, s.depart_hhmm, off, arg_min(frame_id, (abs(epoch(captured_at - (scheduled + to_minutes(off)))), captured_at, frame_id)) as frame_id
from o_services s cross join (select unnest([-30,-10,15,30]) as off) join o_unread f on f.terminal=origin and f.captured_at between scheduled + to_minutes(off-10) and scheduled + to_minutes(off+10) group by 1,2,3,4""")


@query("joi07_fill_offer", f"""
select {KEYS}, o.sailings, o.frames, round(o.frames*0.003e0,4) as cost_usd, case when sufficient then 'newer' else 'thin' end as reason, n>0 as has_history
from o_fill t join (select f.route, f.origin, f.day_type, f.season, f.target_hhmm as depart_hhmm, count(*) as sailings, cast(sum(c.frames) as bigint) as frames, max(f.service_date) as newest from o_fillable f
 join (select origin, service_date, depart_hhmm, count(distinct frame_id) as frames from o_unread_near group by all) c on c.origin=f.origin and c.service_date=f.service_date and c.depart_hhmm=f.depart_hhmm group by 1,2,3,4,5) o
 using (route, origin, day_type, season, depart_hhmm)
left join (select {KEYS}, max(m_date) as newest_sample from o_fill_listed group by all) l using ({KEYS})
where not sufficient or newest_sample is null or o.newest > newest_sample""")
def _(b: Bound) -> DataFrame:
    verdict = brd.board_summary(b.board, b.params).select(
        "route", F.col("terminal").alias("origin"), "service_date", F.col("hhmm").alias("depart_hhmm"),
        F.col("deck_outcome").alias("outcome"), F.col("deck_filled_at").alias("filled_at"), "left_full",
    )
    nothing = F.lit(None)
    records = b.services.join(verdict, KEY).select(
        "*", F.xxhash64(*KEY).alias("service_id"), F.lit("deck_space").alias("method"),
        nothing.cast("boolean").alias("filled"), nothing.cast("boolean").alias("left_behind"),
    )
    answers = cohort.distribution(b.services, records, b.params)
    counts = fill.unread_frame_counts(b.services, b.frames, b.readings, b.params)
    return fill.fill_offers(answers, _fillable(b), counts, b.params)
