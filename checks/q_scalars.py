"""Calendar, clock, rank and text scalars (SCL-*), and row-level claims (PRJ-01..06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.registry import query
from tidewait.functions import calendar as cal
from tidewait.functions import claims, clock
from tidewait.functions.requests import classify_requests
from tidewait.functions.stats import nearest_ranks, rank_correlation, upper_median
from tidewait.functions.wind import period_date, wind_band, wind_brief, wind_speed
from tidewait.operators.records import evidence_per_group


def _order_days(b: Bound) -> DataFrame:
    return b.table("orders").select(F.to_date("o_orderdate").alias("d"))


@query("scl01_weekday_rules", """
select o_orderkey, m + cast((8-isodow(m))%7+7 as int) as second_monday, d - cast(case when isodow(d)=1 then 7 else isodow(d)-1 end as int) as monday_before
from (select o_orderkey, cast(o_orderdate as date) as d, date_trunc('month', cast(o_orderdate as date))::date as m from {orders})""")
def _(b: Bound) -> DataFrame:
    d = F.to_date("o_orderdate")
    return b.table("orders").select(
        "o_orderkey",
        cal.nth_weekday(F.year(d), F.month(d), 0, 2).alias("second_monday"),
        cal.last_weekday_before(d, 0).alias("monday_before"),
    )


@query("scl02_easter_sunday", """
select cast(y as int) as year, easter from o_easter where y in (select year(o_orderdate) from {orders})""")
def _(b: Bound) -> DataFrame:
    years = _order_days(b).select(F.year("d").alias("year")).distinct()
    return years.select("year", cal.easter_sunday(F.col("year")).alias("easter"))


@query("scl03_holiday_calendar", """
select d as day, name, n from o_hol join (select year(o_orderdate) as y, count(*) as n from {orders} group by 1) on y=year(d)""")
def _(b: Bound) -> DataFrame:
    years = _order_days(b).groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return cal.holidays_of_years(years).join(years, "year").select("day", "name", "n")


@query("scl04_day_type", """
select o_orderkey, c.holiday, c.day_type from {orders} join o_cal c on c.d=cast(o_orderdate as date)""")
def _(b: Bound) -> DataFrame:
    d = F.to_date("o_orderdate")
    return b.table("orders").select(
        "o_orderkey", cal.holiday_name(d).alias("holiday"), cal.day_type(d).alias("day_type")
    )


@query("scl05_season", """
select o_orderkey, c.season from {orders} join o_cal c on c.d=cast(o_orderdate as date)""")
def _(b: Bound) -> DataFrame:
    return b.table("orders").select("o_orderkey", cal.season(F.to_date("o_orderdate")).alias("season"))


@query("scl06_long_weekend", """
select o_orderkey, c.long_weekend from {orders} join o_cal c on c.d=cast(o_orderdate as date)""")
def _(b: Bound) -> DataFrame:
    return b.table("orders").select(
        "o_orderkey", cal.is_long_weekend(F.to_date("o_orderdate")).alias("long_weekend")
    )


# January lies wholly in standard time, so the zone is a fixed shift there.
@query("scl07_local_service_date", """
select event_id, cast(ts - interval 8 hour as date) as service_date, strftime(ts - interval 8 hour, '%H:%M') as local_hhmm from {events}""")
def _(b: Bound) -> DataFrame:
    zone = "America/Vancouver"
    return b.table("events").select(
        "event_id", clock.local_date(F.col("ts"), zone).alias("service_date"),
        clock.local_hhmm(F.col("ts"), zone).alias("local_hhmm"),
    )


@query("scl08_combine_local", """
select event_id, cast(ts as date) + cast(strftime(ts,'%H:%M')||':00' as time) + interval 8 hour as instant from {events}""")
def _(b: Bound) -> DataFrame:
    ts = F.col("ts")
    return b.table("events").select(
        "event_id",
        clock.combine_local(F.to_date(ts), F.date_format(ts, "HH:mm"), "America/Vancouver").alias("instant"),
    )


@query("scl09_hhmm_minutes", """
select event_id, cast(hour(ts)*60+minute(ts) as int) as minutes, strftime(ts,'%H:%M') as back from {events}""")
def _(b: Bound) -> DataFrame:
    minutes = clock.hhmm_minutes(F.date_format("ts", "HH:mm"))
    return b.table("events").select(
        "event_id", minutes.alias("minutes"), clock.minutes_hhmm(minutes).alias("back")
    )


@query("scl10_iso_text", """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, date_trunc('second', ts) as parsed,
 date_trunc('second', ts) as naive_parsed, cast(null as timestamp) as bad from {events}""")
def _(b: Bound) -> DataFrame:
    iso = clock.iso_text(F.col("ts"))
    return b.table("events").select(
        "event_id", iso.alias("iso"), clock.parse_iso(iso).alias("parsed"),
        clock.parse_iso(F.regexp_replace(iso, "Z$", "")).alias("naive_parsed"),
        clock.parse_iso(F.concat(F.lit("x"), iso)).alias("bad"),
    )


CLOCK_TEXT = "concat(text, ' sails ', cast(doc_id%27 as string), ':', case when doc_id%7<3 then '0' else '' end, cast(doc_id%64 as string), ' ', case doc_id%5 when 0 then 'am' when 1 then 'p.m.' when 2 then 'PM' else '' end)"


@query("scl11_clock_12_to_24", rf"""
select doc_id, case when h is null or m is null or m>59 then null
  when mark='' then case when h<=23 then printf('%02d:%02d', h, m) end
  when h between 1 and 12 then printf('%02d:%02d', h%12 + case when mark='pm' then 12 else 0 end, m) end as hhmm
from (select doc_id, try_cast(regexp_extract(t, p, 1) as int) as h, try_cast(regexp_extract(t, p, 2) as int) as m,
  lower(replace(regexp_extract(t, p, 3), '.', '')) as mark
 from (select doc_id, {CLOCK_TEXT} as t, '(?i)\b(\d{{1,2}}):(\d{{2}})\s*(am|pm|a\.m\.|p\.m\.)?' as p from {{documents}}))""")
def _(b: Bound) -> DataFrame:
    return b.sql(f"select doc_id, {CLOCK_TEXT} as t from {{documents}}").select(
        "doc_id", clock.first_clock(F.col("t")).alias("hhmm")
    )


@query("scl12_dateless_stamp", """
select event_id, case when d + t - ts > interval 12 hour then d - 1 + t else d + t end as reported_at
from (select event_id, ts, cast(ts as date) as d, cast(printf('%02d:%02d:00', (k*7)%24, k%60) as time) as t from e)""")
def _(b: Bound) -> DataFrame:
    hhmm = F.format_string("%02d:%02d", (F.col("k") * 7) % 24, F.col("k") % 60)
    return b.view("e").select(
        "event_id", clock.dateless_stamp(F.col("ts"), hhmm, "UTC").alias("reported_at")
    )


@query("scl13_midnight_roll", """
select event_id, case when s - dep > interval 12 hour then dep + interval 1 day else dep end as departed_at
from (select event_id, cast(ts as date) + cast('21:40:00' as time) as s,
 cast(ts as date) + cast(printf('%02d:%02d:00', (21+k%5)%24, k%60) as time) as dep from e)""")
def _(b: Bound) -> DataFrame:
    day = F.to_date("ts")
    scheduled = clock.combine_local(day, F.lit("21:40"), "UTC")
    left = clock.combine_local(day, F.format_string("%02d:%02d", (F.col("k") % 5 + 21) % 24, F.col("k") % 60), "UTC")
    return b.view("e").select("event_id", clock.midnight_roll(left, scheduled).alias("departed_at"))


@query("scl14_minute_gaps", """
select service_id, cast(floor(epoch(scheduled-filled_at)/60) as int) as floored, case when filled_at is not null then cast(greatest(floor(epoch(scheduled-filled_at)/60),0) as int) end as clamped,
 abs(epoch(departed_at-scheduled)) as seconds from o_records""")
def _(b: Bound) -> DataFrame:
    s, f = F.col("scheduled"), F.col("filled_at")
    return b.records.select(
        "service_id", clock.minutes_floor(s, f).alias("floored"),
        clock.minutes_clamped(s, f).alias("clamped"),
        clock.seconds_apart(F.col("departed_at"), s).alias("seconds"),
    )


@query("scl22_nearest_rank", """
select l_orderkey, count(*) as n, max(q) as max, list_sort(list(q))[cast(round_even(0.25*(count(*)-1),0) as int)+1] as p25,
 list_sort(list(q))[cast(round_even(0.5*(count(*)-1),0) as int)+1] as median, list_sort(list(q))[cast(round_even(0.75*(count(*)-1),0) as int)+1] as p75
from (select l_orderkey, cast(floor(l_quantity) as int) as q from {lineitem}) group by 1""")
def _(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select("l_orderkey", F.floor("l_quantity").cast("int").alias("q"))
    return nearest_ranks(rows, ["l_orderkey"], "q", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query("scl23_upper_median", """
select l_orderkey, list_sort(list(q))[count(*)//2+1] as upper_median from (select l_orderkey, cast(floor(l_quantity) as int) as q from {lineitem}) group by 1""")
def _(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select("l_orderkey", F.floor("l_quantity").cast("int").alias("q"))
    return rows.groupBy("l_orderkey").agg(upper_median("q").cast("int").alias("upper_median"))


@query("agg24_trend_rank_correlation", """
select k as l_orderkey, n, round(case when n>=3 and dx>0 and dy>0 then num/sqrt(dx*dy) end, 4) as rho from (
 select l_orderkey as k, count(*) as n, sum((rx-mx)*(rx-mx)) as dx, sum((ry-my)*(ry-my)) as dy, sum((rx-mx)*(ry-my)) as num from (
  select *, avg(rx) over (partition by l_orderkey) as mx, avg(ry) over (partition by l_orderkey) as my from (
   select l_orderkey, rank() over (partition by l_orderkey order by l_quantity) + (count(*) over (partition by l_orderkey, l_quantity)-1)/2.0 as rx,
    rank() over (partition by l_orderkey order by l_linenumber) + (count(*) over (partition by l_orderkey, l_linenumber)-1)/2.0 as ry from {lineitem})) group by 1)""")
def _(b: Bound) -> DataFrame:
    rho = rank_correlation(b.table("lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")
    return rho.select("l_orderkey", "n", F.round("rho", 4).alias("rho"))


WIND_TEXT = """concat('Wind ', case doc_id%6 when 0 then 'northwest' when 1 then 'southeast' when 2 then 'light' when 3 then 'north becoming southwest' when 4 then 'gale force west' else 'variable' end,
 ' ', case when doc_id%4=0 then concat(cast(doc_id%40+5 as string),' to ',cast(doc_id%40+10 as string),' knots') when doc_id%4=1 then concat(cast(doc_id%60 as string),' knots except ',cast(doc_id%90 as string)) when doc_id%4=2 then concat(cast(doc_id%99+140 as string), ' then 20 to 30') else '' end, '. ', text)"""


@query("scl17_wind_scalars", rf"""
select doc_id, kt as wind_max_kt, case when kt is null then 'unknown' when kt>=48 then 'storm' when kt>=34 then 'gale' when kt>=20 then 'strong' else 'light' end as band,
 nullif(concat_ws(' ', dir, case when s1>0 and try_cast(hi as int)<=150 and (n1 is null or s1<=pos1) then lo||'–'||hi||' kt' when n1 is not null then n1||' kt'
  else case when lw like '%hurricane%' then 'hurricane' when lw like '%storm%' then 'storm' when lw like '%gale%' then 'gale' when lw like '%strong wind%' then 'strong wind' when lw like '%light%' then 'light' end end), '') as brief
from (select *, coalesce(list_max(nums), case when lw like '%hurricane%' then 64 when lw like '%storm%' then 48 when lw like '%gale%' then 34 when lw like '%strong wind%' then 20 when lw like '%light%' then 10 end) as kt,
  cast(nums[1] as string) as n0, raw[1] as n1,
  length(regexp_extract(t, '(?s)^(.*?)\b\d{{1,3}}\s+to\s+\d{{1,3}}\b', 1)) + case when regexp_matches(t, '\b\d{{1,3}}\s+to\s+\d{{1,3}}\b') then 1 else 0 end as s1,
  regexp_extract(t, '\b(\d{{1,3}})\s+to\s+(\d{{1,3}})\b', 1) as lo, regexp_extract(t, '\b(\d{{1,3}})\s+to\s+(\d{{1,3}})\b', 2) as hi,
  length(regexp_extract(t, '(?s)^(.*?)\b'||raw[1]||'\b', 1))+1 as pos1,
  (select arg_min(short, (p, -length(w))) from (select w, short, strpos(lw, w) as p from (values ('northwest','NW'),('northeast','NE'),('southwest','SW'),('southeast','SE'),('north','N'),('south','S'),('east','E'),('west','W')) d(w,short)) where p>0) as dir
 from (select doc_id, t, lower(t) as lw, list_filter(list_transform(regexp_extract_all(t, '\b(\d{{1,3}})\b', 1), lambda x: cast(x as int)), lambda x: x<=150) as nums,
   list_filter(regexp_extract_all(t, '\b(\d{{1,3}})\b', 1), lambda x: cast(x as int)<=150) as raw
  from (select doc_id, {WIND_TEXT} as t from {{documents}})))""")
def _(b: Bound) -> DataFrame:
    wind = b.sql(f"select doc_id, {WIND_TEXT} as t from {{documents}}")
    knots = wind_speed(F.col("t"))
    return wind.select(
        "doc_id", knots.alias("wind_max_kt"), wind_band(knots).alias("band"),
        wind_brief(F.col("t")).alias("brief"),
    )


LABEL = "case o_orderkey%9 when 0 then 'Today' when 1 then 'Tonight' when 2 then 'This afternoon' when 3 then 'Thursday' when 4 then 'thursday night' when 5 then 'Sunday' when 6 then 'Monday night' when 7 then 'Later' else ' ' end"


@query("scl19_period_label_date", f"""
select o_orderkey, case when l in ('today','tonight') or starts_with(l,'this ') then d when w is not null then d + cast(case when (w-isodow(d)+14)%7=0 then 7 else (w-isodow(d)+14)%7 end as int) end as service_date,
 case when l='tonight' then 'night' when l='today' or starts_with(l,'this ') then 'day' when w is not null then case when l like '%night' then 'night' else 'day' end end as kind
from (select *, case split_part(l,' ',1) when 'monday' then 1 when 'thursday' then 4 when 'sunday' then 7 end as w
 from (select o_orderkey, cast(o_orderdate as date) as d, lower(trim({LABEL})) as l from {{orders}}))""")
def _(b: Bound) -> DataFrame:
    rows = b.sql(f"select o_orderkey, cast(o_orderdate as date) as d, {LABEL} as label from {{orders}}")
    date, half = period_date(F.col("label"), F.col("d"))
    return rows.select("o_orderkey", date.alias("service_date"), half.alias("kind"))


@query("prj01_is_moving", """
select row_id, case lower(trim(status)) when 'under way' then true when 'stopped' then false else speed_knots>0 end as moving from v_positions""")
def _(b: Bound) -> DataFrame:
    return b.view("v_positions").select(
        "row_id", claims.is_moving(F.col("status"), F.col("speed_knots")).alias("moving")
    )


@query("prj02_usable_gate", """
select frame_id, confidence>=0.35 and case when version='model' then dock and band is not null
 else case when frame_id%5=0 then 'dark' when frame_id%5=1 then 'dim' end is distinct from 'dark' and vehicle_count is not null end as usable from v_readings""")
def _(b: Bound) -> DataFrame:
    visible = F.when(F.col("version") == "model", F.col("dock"))
    visibility = F.when(F.col("frame_id") % 5 == 0, "dark").when(F.col("frame_id") % 5 == 1, "dim")
    return b.view("v_readings").select(
        "frame_id",
        claims.usable_reading(
            F.col("confidence"), visible, F.col("band"), visibility, F.col("vehicle_count"), b.params.min_confidence
        ).alias("usable"),
    )


NOTICE = "concat(text, case doc_id%5 when 0 then ' Peak travel. LOADING maximum number of vehicles' when 1 then ' Departed: 9:56 am' when 2 then ' departed on schedule today 9:56' when 3 then ' Departed 10:41' else '' end)"


@query("prj03_notice_predicates", rf"""
select doc_id, regexp_matches(t, '(?i)loading maximum number of vehicles') as full, regexp_matches(t, '(?i)\bdeparted\b[^\d]{{0,12}}\d{{1,2}}:\d{{2}}') as departed_text,
 dep is not null or regexp_matches(t, '(?i)\bdeparted\b[^\d]{{0,12}}\d{{1,2}}:\d{{2}}') as departed
from (select doc_id, {NOTICE} as t, case when doc_id%11=0 then '09:00' end as dep from {{documents}})""")
def _(b: Bound) -> DataFrame:
    rows = b.sql(f"select doc_id, {NOTICE} as t, case when doc_id%11=0 then '09:00' end as dep from {{documents}}")
    return rows.select(
        "doc_id", claims.says_full(F.col("t")).alias("full"),
        claims.says_departed(F.col("t")).alias("departed_text"),
        claims.row_departed(F.col("dep"), F.col("t")).alias("departed"),
    )


@query("prj04_outcome_from_axes", """
select doc_id, case when doc_id%9=0 then 'cancelled' when doc_id%4=1 then 'waited_1' when doc_id%4=2 and doc_id%3=0 then 'waited_2plus' when filled then 'filled'
 when filled=false or left_behind=false then 'boarded' else 'unknown' end as outcome from v_axes""")
def _(b: Bound) -> DataFrame:
    waited = F.when(F.col("doc_id") % 4 == 1, "waited_1").when(
        (F.col("doc_id") % 4 == 2) & (F.col("doc_id") % 3 == 0), "waited_2plus"
    )
    return b.view("v_axes").select(
        "doc_id",
        claims.outcome_from_axes(
            F.col("filled"), F.col("left_behind"), F.col("doc_id") % 9 == 0, waited
        ).alias("outcome"),
    )


@query("prj05_axes_from_outcome", """
select service_id, case when filled is null and left_behind is null then case when outcome in ('waited_1','waited_2plus','filled') then true when outcome='boarded' then false end else filled end as filled,
 case when filled is null and left_behind is null then case when outcome in ('waited_1','waited_2plus') then true when outcome='boarded' then false end else left_behind end as left_behind from o_records""")
def _(b: Bound) -> DataFrame:
    filled, left = claims.effective_axes(F.col("filled"), F.col("left_behind"), F.col("outcome"))
    return b.records.select("service_id", filled.alias("filled"), left.alias("left_behind"))


@query("prj06_evidence_kind", """
select route, origin, depart_hhmm, day_type, season, count(*) as n, case count(distinct k) when 0 then 'unknown' when 1 then max(k) else 'mixed' end as evidence
from (select *, case when method like 'frames%' then 'frames' when method like 'report%' then 'report' when method like 'import%' then 'import' when method like 'deck_space%' then 'deck_space' end as k from o_records)
group by all""")
def _(b: Bound) -> DataFrame:
    return evidence_per_group(b.records, ["route", "origin", "depart_hhmm", "day_type", "season"])


# Agents as browsers and machines send them.
AGENTS = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Linux; Android 14; SM-X700) AppleWebKit/537.36 SamsungBrowser/23.0 Chrome/115.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Googlebot/2.1 (+http://www.google.com/bot.html)",
    "",
    "Something else",
)


@query("prj09_request_classification", """
select page_id, a as agent_no, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host,
 ['Safari','Microsoft Edge','Samsung Internet','Firefox',null,null,'unknown'][a+1] as browser,
 ['iOS','Windows','Android','Linux',null,null,'unknown'][a+1] as visitor_os,
 ['Mobile','Desktop','Tablet','Desktop',null,null,'unknown'][a+1] as device,
 nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as utm_source
from (select *, page_id%7 as a, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), ''), '') as p from {pages})
where a not in (4,5) and not regexp_matches(p, '^(/healthz|/static/|/favicon.ico|/manifest.webmanifest|/api/docs|/openapi.json)')""")
def _(b: Bound) -> DataFrame:
    agents = F.array(*[F.lit(a) for a in AGENTS])
    number = (F.col("page_id") % len(AGENTS)).cast("int")
    log = b.table("pages").select(
        "page_id", "url", number.alias("agent_no"), F.element_at(agents, number + 1).alias("agent")
    )
    return classify_requests(log).select(
        "page_id", F.col("agent_no").cast("bigint").alias("agent_no"), "host", "browser", "visitor_os", "device", "utm_source"
    )
