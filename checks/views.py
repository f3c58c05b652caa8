"""Driver tables bound to the model's shapes.

`VIEWS` are portable: the same text runs in Spark and in the check engine. `SHAPES` are the
check engine's further steps; the Spark side builds the same shapes with the library.
"""

from __future__ import annotations

import re

# Terminal, slot and clock of the daily services.
CLOCKS = {
    "A": ("05:35", "07:25", "09:25", "11:45", "14:30", "16:55", "19:05", "21:00"),
    "B": ("06:30", "08:20", "10:35", "12:55", "15:40", "18:00", "20:05", "22:00"),
}
SLOTS = [(t, k, clock) for t, clocks in CLOCKS.items() for k, clock in enumerate(clocks)]

VIEWS = {
    "v_slots": f"select * from (values {', '.join(map(str, SLOTS))}) as s(terminal,slot,hhmm)",
    "v_blocks": """
select * from (values
 (1,'A',date '2024-01-01',date '2024-01-20','0123456','05:35,07:25,09:25,11:45,14:30,16:55,19:05,21:00'),
 (2,'B',date '2024-01-01',date '2024-01-31','0123456','06:30,08:20,10:35,12:55,15:40,18:00,20:05,22:00'),
 (3,'A',date '2024-01-15',date '2024-01-31','56','05:35,09:25,23:50'),
 (4,'A',date '2024-01-21',date '2024-01-31','0123456','05:35,07:25,09:25,11:45,14:30,16:55,19:05,21:00')) as b(block_no,terminal,eff_from,eff_to,days,departures)""",
    "v_readings": """
select event_id as frame_id, case when user_id%2=0 then 'A' else 'B' end as terminal,
 case when user_id%5=0 then 'road' else 'main' end as camera, ts as captured_at, cast(ts as date) as service_date,
 case when event_type='error' then 'error' else 'ok' end as status,
 case k%3 when 0 then 'lane' when 1 then 'extent' else 'model' end as version,
 case when k%4=0 then null else cast(floor(value) as int)%150 end as vehicle_count,
 case when k<25 then 'empty' when k<45 then 'light' when k<65 then 'moderate' when k<85 then 'heavy' when k<95 then 'overflowing' end as band,
 k%7=0 as dock, k%11=0 as beyond, k/100.0e0 as confidence, k%10<>0 as usable,
 case when k%6=0 then null else k%11 end as lanes_occupied from e""",
    "v_board": """
select event_id as row_id, case when user_id%2=0 then 'A' else 'B' end as terminal, ts as observed_at,
 cast(ts as date) as service_date, k%8 as slot, case when k%5=0 then null when k<10 then 0 else k end as percent_available,
 case when k=0 then 'cancelled' when k between 1 and 4 then 'Peak travel. Loading maximum number of vehicles'
  when k>=90 then 'Departed 9:56 am' else 'Upcoming' end as status_text,
 case when k>=85 then k%40 end as late_minutes, case when k%17=0 and k>0 then 'error' else 'ok' end as fetch_status
 from e where event_type in ('click','view')""",
    "v_positions": """
select event_id as row_id, case when cast(ts as date)=date '2024-01-15' and user_id%2=0 then 'V2' else 'V1' end as vessel,
 ts as reported_at, case when k<45 then 'Stopped' when k<85 then 'Under Way' else 'Docking' end as status,
 case when k%10=0 then null when value<40 then 0.0e0 else value end as speed_knots
 from e where event_type in ('purchase','signup')""",
    "v_records": """
select o_orderkey as sailing_id, case when o_custkey%3=0 then 'r2' else 'r1' end as route,
 case when o_custkey%2=0 then 'A' else 'B' end as origin, cast(o_orderdate as date) as service_date, o_orderkey%8 as slot,
 case when o_orderpriority='1-URGENT' then 'boarded' when o_orderpriority='2-HIGH' then 'filled'
  when o_orderpriority='3-MEDIUM' then case o_orderstatus when 'F' then 'waited_1' when 'O' then 'waited_2plus' else 'boarded' end
  when o_orderpriority='4-NOT SPECIFIED' then 'unknown' when o_orderstatus='P' then 'cancelled' else 'boarded' end as outcome,
 o_orderkey%4=0 as axes_missing, case when o_custkey%5=0 then null else o_custkey%5<3 end as left_behind_hint,
 case o_orderkey%3 when 0 then null when 1 then true else false end as left_full,
 case when o_orderkey%3<>0 then cast(floor(o_totalprice) as int)%120-5 end as fill_lead_raw,
 case when o_orderkey%6=0 then o_custkey%30 end as left_late,
 case o_orderkey%5 when 0 then 'frames:lane' when 1 then 'deck_space' when 2 then 'report' when 3 then 'import:csv' end as method
 from {orders}""",
    "v_reports": """
select r.route, r.origin, r.service_date, r.slot, r.sailing_id, l_returnflag<>'R' as boarded,
 cast(floor(l_quantity*4) as int)-10 as lead_minutes,
 case when l_returnflag='R' and l_linenumber%3<>0 then l_linenumber%3 end as sailings_waited,
 case when l_discount<0.02 then null else l_linenumber*5-8 end as late_minutes, l_linenumber, l_partkey, l_suppkey,
 concat(cast(l_orderkey as string),'-',cast(l_linenumber as string),'-',cast(l_partkey as string),'-',cast(l_suppkey as string),
  '-',cast(cast(floor(l_extendedprice*100+0.5) as bigint) as string),'-',cast(cast(floor(l_quantity*100+0.5) as bigint) as string)) as report_id
 from {lineitem} join v_records r on r.sailing_id=l_orderkey""",
    # First-hand reports about the month of events: the feed that neither board nor tracker takes, for some slots.
    "v_event_reports": """
select event_id as row_id, case when user_id%2=0 then 'A' else 'B' end as origin, cast(ts as date) as service_date, k%8 as slot, user_id%3<>0 as boarded,
 case when user_id%9=0 then 1 when user_id%9=3 then 2 end as sailings_waited from e where event_type='error' and k<16 and k%8 in (1,4,6)""",
    "v_forecasts": """
select l_suppkey%10 as site, case when l_suppkey%2=0 then 'r1' else 'r2' end as route, cast(l_shipdate as date) as service_date,
 cast(l_shipdate as date)-l_linenumber as issued_on, l_partkey as issue_seq,
 case when l_linestatus='O' then 'regular' else 'extended' end as kind,
 case when l_tax=0 then null else cast(floor(l_quantity) as int) end as wind_max_kt, l_discount<0.09 as ok, l_orderkey, l_linenumber,
 cast(floor(l_extendedprice*100+0.5) as bigint) as cents
 from {lineitem}""",
    "v_axes": """
select d.doc_id, l.quality=1 as filled, l.toxic=1 as left_behind from {documents} d left join {labels} l on d.doc_id=l.doc_id""",
    "v_pixels": """
select vec_id as frame_id, label as hour, embedding from {embeddings}""",
}

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

E_SPARK = "select *, cast(get_json_object(props,'$.k') as int) as k from {events}"
E_CHECK = "select *, cast(json_extract_string(props,'$.k') as int) as k from {events}"

SHAPES: dict[str, str] = {}


def shape(name: str, text: str) -> None:
    SHAPES[name] = text


def _needed(text: str, known: dict[str, str], order: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"\b(?:e|v_\w+|o_\w+)\b", text)):
        if name in known and name not in order:
            # A recursive CTE names itself.
            own = {n: t for n, t in known.items() if n != name}
            _needed(known[name], own, order)
            order.append(name)


def spark_sql(text: str, sf_dir: str, instead: dict[str, str] | None = None) -> str:
    known = {"e": E_SPARK, **VIEWS}
    order: list[str] = []
    _needed(text, known, order)
    ctes = ",\n".join(f"{n} as ({known[n]})" for n in order)
    full = (f"with {ctes}\n" if ctes else "") + text
    for table, view in (instead or {}).items():
        full = full.replace("{" + table + "}", view)
    for table in BASE:
        full = full.replace("{" + table + "}", f"parquet.`{sf_dir.rstrip('/')}/{table}.parquet`")
    return full


def check_sql(text: str) -> str:
    """A self-contained query for the check engine: only the CTEs it needs."""
    known = {"e": E_CHECK, **VIEWS, **SHAPES}
    order: list[str] = []
    _needed(text, known, order)
    ctes = ",\n".join(f"{n} as ({known[n]})" for n in order)
    full = (f"with recursive {ctes}\n" if ctes else "") + text
    for table in BASE:
        full = full.replace("{" + table + "}", table)
    return full


# ---- calendar ---------------------------------------------------------------------------
shape("o_days", """
select distinct cast(ts as date) as d from {events}
union select distinct cast(o_orderdate as date) from {orders}""")
shape("o_years", """
select cast(y as bigint) as y from (select min(year(d))-1 as a, max(year(d))+1 as b from o_days), range(a, b+1) t(y)""")
shape("o_easter", """
select y, make_date(y, (h+l-7*m+114)//31, (h+l-7*m+114)%31+1) as easter from (
 select *, (a+11*h+22*l)//451 as m from (
  select *, (32+2*e_+2*i-h-k_)%7 as l from (
   select *, (19*a+b-d_-g+15)%30 as h from (
    select *, (b-f+1)//3 as g from (
     select y, y%19 as a, y//100 as b, y%100 as c, (y//100)//4 as d_, (y//100)%4 as e_, (y//100+8)//25 as f,
      (y%100)//4 as i, (y%100)%4 as k_ from o_years)))))""")
shape("o_hol", """
select make_date(y,1,1) as d, 'New Year''s Day' as name from o_years
union all select make_date(y,2,1) + cast((8-isodow(make_date(y,2,1)))%7+14 as int), 'Family Day' from o_years
union all select easter - 2, 'Good Friday' from o_easter
union all select make_date(y,5,24) - cast(isodow(make_date(y,5,24))-1 as int), 'Victoria Day' from o_years
union all select make_date(y,7,1), 'Canada Day' from o_years
union all select make_date(y,8,1) + cast((8-isodow(make_date(y,8,1)))%7 as int), 'BC Day' from o_years
union all select make_date(y,9,1) + cast((8-isodow(make_date(y,9,1)))%7 as int), 'Labour Day' from o_years
union all select make_date(y,9,30), 'National Day for Truth and Reconciliation' from o_years
union all select make_date(y,10,1) + cast((8-isodow(make_date(y,10,1)))%7+7 as int), 'Thanksgiving' from o_years
union all select make_date(y,11,11), 'Remembrance Day' from o_years
union all select make_date(y,12,25), 'Christmas Day' from o_years""")
shape("o_cal", """
select o_days.d, h.name as holiday,
 case when h.d is not null or isodow(o_days.d)=7 then 'sunday_holiday' when isodow(o_days.d)=6 then 'saturday'
  when isodow(o_days.d)=5 then 'friday' else 'weekday' end as day_type,
 case when strftime(o_days.d,'%m%d')>='0625' and o_days.d <= lab.d then 'peak_summer'
  when (strftime(o_days.d,'%m%d')>='0401' and strftime(o_days.d,'%m%d')<'0625') or (o_days.d > lab.d and strftime(o_days.d,'%m%d')<='1031') then 'shoulder'
  else 'winter' end as season,
 (h.d is not null or (isodow(o_days.d)=6 and o_days.d+2 in (select d from o_hol))
  or (isodow(o_days.d)=7 and (o_days.d+1 in (select d from o_hol) or o_days.d-2 in (select d from o_hol)))
  or (isodow(o_days.d)=5 and o_days.d+3 in (select d from o_hol))) as long_weekend
from o_days left join o_hol h on h.d=o_days.d
join o_hol lab on lab.name='Labour Day' and year(lab.d)=year(o_days.d)""")

# ---- services ---------------------------------------------------------------------------
shape("o_services", """
select 'r1' as route, terminal as origin, case terminal when 'A' then 'B' else 'A' end as destination, d as service_date,
 hhmm as depart_hhmm, d + cast(hhmm||':00' as time) as scheduled, block_no, day_type, season, long_weekend from (
 select block_no, terminal, ev.d, unnest(string_split(departures, ',')) as hhmm
 from (select distinct cast(ts as date) as d from {events}) ev
 join v_blocks on ev.d between eff_from and eff_to and contains(days, cast(isodow(ev.d)-1 as string))) x
join o_cal using (d)
qualify row_number() over (partition by d, terminal, hhmm order by block_no)=1""")
shape("o_neigh", """
select *, lag(scheduled) over w as prev_dep, lead(scheduled) over w as next_dep from o_services
window w as (partition by route, origin, service_date order by scheduled)""")

# ---- frames and readings ----------------------------------------------------------------
shape("o_frames", """
select frame_id, terminal, camera, date_trunc('second', captured_at) as captured_at, service_date, status, version,
 vehicle_count, band, dock, beyond, confidence, usable, lanes_occupied,
 case when status='ok' then 'f/'||cast(frame_id as string) end as path
from v_readings qualify row_number() over (partition by terminal, camera, date_trunc('second', captured_at) order by frame_id)=1""")
shape("o_readings", "select * from o_frames where status='ok'")
shape("o_usable", "select * from o_readings where usable")

# ---- board, positions, reports ----------------------------------------------------------
shape("o_board", """
select row_id, 'r1' as route, b.terminal, date_trunc('second', observed_at) as observed_at, service_date, s.hhmm,
 percent_available, status_text, fetch_status,
 case when late_minutes is not null then strftime(service_date + cast(s.hhmm||':00' as time) + to_minutes(late_minutes), '%H:%M') end as departed_hhmm,
 service_date + cast(s.hhmm||':00' as time) as scheduled,
 service_date + cast(s.hhmm||':00' as time) + to_minutes(late_minutes) as departed_at
from v_board b join v_slots s on s.terminal=b.terminal and s.slot=b.slot
qualify row_number() over (partition by b.terminal, date_trunc('second', observed_at), s.hhmm order by row_id)=1""")
shape("o_board_sum", """
select route, terminal as origin, service_date, hhmm as depart_hhmm, scheduled,
 min(percent_available) as deck_space_min,
 bool_or(status_text ilike '%loading maximum number of vehicles%') filter (fetch_status='ok') as left_full,
 coalesce(bool_or(lower(status_text)='cancelled') filter (fetch_status='ok'), false) as said_cancelled,
 count(percent_available) filter (fetch_status='ok') as n_percent,
 max(observed_at) filter (fetch_status='ok' and percent_available is not null and observed_at<=scheduled) as last_before,
 min(observed_at) filter (fetch_status='ok' and percent_available<=0 and observed_at<=scheduled) as first_full,
 min(observed_at) filter (fetch_status='ok' and (departed_hhmm is not null or status_text ilike 'departed%')) as first_gone,
 max(observed_at) filter (fetch_status='ok') as watched_until,
 arg_max(departed_at, (observed_at,row_id)) filter (fetch_status='ok' and departed_hhmm is not null) as board_departed_at
from o_board group by all""")
shape("o_board_class", """
select *, case when outcome='filled' then first_full end as filled_at,
 case when outcome='cancelled' then 0.6e0 when outcome='filled' then 0.7e0 when outcome='boarded' and n_percent=0 then 0.55
  when outcome='boarded' and scheduled - last_before <= interval 20 minute then 0.65 when outcome='boarded' then 0.5 end as deck_confidence
from (select *, case when said_cancelled then 'cancelled'
  when n_percent=0 then case when first_gone is null or left_full or watched_until - first_gone < interval 15 minute then 'unknown' else 'boarded' end
  when last_before is null then 'unknown' when first_full is not null then 'filled'
  when scheduled - last_before > interval 45 minute then 'unknown' else 'boarded' end as outcome from o_board_sum)""")
shape("o_pos", """
select row_id, 'r1' as route, vessel, date_trunc('second', reported_at) as reported_at, status, speed_knots
from v_positions qualify row_number() over (partition by vessel, date_trunc('second', reported_at) order by row_id)=1""")
shape("o_moving", """
select * from (select *, cast(reported_at as date) as d, case lower(trim(status)) when 'under way' then true when 'stopped' then false
 else speed_knots>0 end as moving from o_pos) where moving is not null""")
shape("o_moments", """
select d, reported_at as moment, row_number() over (partition by d order by reported_at, row_id) as position from (
 select *, lag(moving) over (partition by d order by reported_at, row_id) as was from o_moving
 where d in (select cast(reported_at as date) from o_pos group by 1 having count(distinct vessel)=1))
where moving and was = false""")
shape("o_published", """
select distinct terminal, service_date, hhmm, departed_hhmm, departed_at as left_at from o_board
where fetch_status='ok' and departed_hhmm is not null""")
shape("o_anchored", """
select m.d, m.position, m.moment, arg_min(p.terminal, (p.left_at, p.terminal)) as anchor
from o_moments m left join o_published p on p.left_at between m.moment - interval 15 minute and m.moment + interval 15 minute
group by all""")
shape("o_breaks", """
select d, position as at from (select *, lag(moment) over (partition by d order by position) as prev from o_anchored)
 where moment - prev < interval 30 minute
union select d, unnest([position+1, nxt]) from (
 select d, position, anchor, lead(position) over w as nxt, lead(anchor) over w as nxt_anchor from o_anchored where anchor is not null
 window w as (partition by d order by position))
 where nxt is not null and (anchor=nxt_anchor) <> ((nxt-position)%2=0)""")
shape("o_segments", """
select a.*, (select count(*) from o_breaks b where b.d=a.d and b.at<=a.position) as segment from o_anchored a""")
shape("o_ledger", """
select s.d, s.position, s.moment, s.anchor, s.segment,
 case when f.a is not null then case when (s.position-f.p)%2=0 then f.a else case f.a when 'A' then 'B' else 'A' end end end as terminal
from o_segments s left join (select d, segment, min(position) as p, arg_min(anchor, position) as a from o_segments where anchor is not null group by 1,2) f
 on f.d=s.d and f.segment=s.segment""")
shape("o_slots_of", """
select origin, service_date, depart_hhmm, scheduled, row_number() over (partition by origin, service_date order by scheduled) as i from o_services""")
shape("o_left", "select terminal as origin, d as service_date, list(distinct moment order by moment) as deps from o_ledger where terminal is not null group by all")
shape("o_walk", """
select l.origin, l.service_date, cast(0 as bigint) as i, cast(null as string) as depart_hhmm, cast(null as timestamp) as tracked_at, l.deps as free from o_left l
union all
select w.origin, w.service_date, s.i, s.depart_hhmm,
 list_filter(w.free, lambda t: t between s.scheduled - interval 20 minute and s.scheduled + interval 75 minute)[1],
 case when list_filter(w.free, lambda t: t between s.scheduled - interval 20 minute and s.scheduled + interval 75 minute)[1] is null then w.free
  else list_filter(w.free, lambda t: t <> list_filter(w.free, lambda t2: t2 between s.scheduled - interval 20 minute and s.scheduled + interval 75 minute)[1]) end
from o_walk w join o_slots_of s on s.origin=w.origin and s.service_date=w.service_date and s.i=w.i+1""")
shape("o_tracked", "select origin, service_date, depart_hhmm, tracked_at from o_walk where tracked_at is not null")
shape("o_reports", """
select report_id, r.route, r.origin, r.service_date, s.hhmm as depart_hhmm, r.boarded, r.sailings_waited, sailing_id, l_linenumber, l_partkey,
 r.service_date + cast(s.hhmm||':00' as time) as scheduled,
 r.service_date + cast(s.hhmm||':00' as time) - to_minutes(lead_minutes) as joined_at,
 r.service_date + cast(s.hhmm||':00' as time) + to_minutes(late_minutes) as departed_at
from v_reports r join v_slots s on s.terminal=r.origin and s.slot=r.slot""")
shape("o_records", """
select r.sailing_id as service_id, r.route, r.origin, r.service_date, s.hhmm as depart_hhmm, r.outcome, r.method, r.left_full,
 r.service_date + cast(s.hhmm||':00' as time) as scheduled, c.day_type, c.season, c.long_weekend,
 cast(split_part(s.hhmm,':',1) as int)*60+cast(split_part(s.hhmm,':',2) as int) as minutes,
 case when axes_missing then null when outcome in ('waited_1','waited_2plus','filled') then true when outcome='boarded' then false end as filled,
 case when axes_missing then null when outcome in ('waited_1','waited_2plus') then true when outcome='filled' then left_behind_hint
  when outcome='boarded' then false end as left_behind,
 case when outcome in ('filled','waited_1','waited_2plus') then r.service_date + cast(s.hhmm||':00' as time) - to_minutes(fill_lead_raw) end as filled_at,
 r.service_date + cast(s.hhmm||':00' as time) + to_minutes(left_late) as departed_at,
 case when left_late is not null then case when left_late%2=0 then 'board' else 'tracking' end end as departed_source
from v_records r join v_slots s on s.terminal=r.origin and s.slot=r.slot join o_cal c on c.d=r.service_date""")
