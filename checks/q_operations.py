"""Sources, sinks, forecasts, retention, health, spend, set operations and page text."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.q_evidence import KEY, KEYS
from checks.q_history import _known_services
from checks.registry import query
from checks.views import shape
from tidewait.functions.calendar import day_type, season
from tidewait.functions.clock import add_minutes
from tidewait.operators import board as brd
from tidewait.operators import forecast, quality, retention, spend
from tidewait.params import Params
from tidewait.sources import frames as fr
from tidewait.sources import imports, listings, pages, sinks, tables
from tidewait.sources.forecast_xml import marine_forecast_rows, shore_forecast_rows


# ---- sources ----------------------------------------------------------------------------
@query("src01_scan_tables", """
select service_date, terminal, count(*) as rows, count(*) filter (status='error') as errors, max(captured_at) as last_at from o_frames group by all""")
def _(b: Bound) -> DataFrame:
    root = tables.fresh_dir(b.spark, "scan")
    rows = b.frames.select("frame_id", "terminal", "camera", "captured_at", "service_date", "path", "status")
    sinks.overwrite_dates(rows, f"{root}/frames")
    back = tables.read_table(b.spark, root, "frames")
    return back.groupBy("service_date", "terminal").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        F.max("captured_at").alias("last_at"),
    )


IMPORT_ROWS = """select case when sailing_id%13=0 then '1997-02-30' else cast(r.service_date as string) end as service_date, case when sailing_id%17=0 then 'Q' else origin end as origin,
 case when sailing_id%29=0 then '5h35' else s.hhmm end as depart_hhmm, outcome, case when sailing_id%3=0 then cast(sailing_id%90 as string) end as peak_queue, cast(null as string) as carryover, case when sailing_id%2=0 then 'sheet' end as source, sailing_id
 from v_records r join v_slots s on s.terminal=r.origin and s.slot=r.slot"""


# A row's cells as written; every 19th line ends two cells early, every 23rd has one too many.
LINE = """service_date||','||origin||','||depart_hhmm||','||outcome||case when sailing_id%19=0 then '' else ','||coalesce(peak_queue,'')||','||coalesce(carryover,'')||','||coalesce(source,'')||case when sailing_id%23=0 then ',extra' else '' end end"""
MALFORMED = "(sailing_id%19=0 or sailing_id%23=0)"


@query("src03_import_outcomes", f"""
select service_date, origin, depart_hhmm, outcome, case when reason is null then case when outcome in ('waited_1','waited_2plus') then true when outcome='boarded' then false end end as filled,
 case when reason is null then outcome in ('waited_1','waited_2plus') end as overload, case when reason is null then 'import:'||coalesce(source,'manual') end as method, cast(peak_queue as int) as peak_queue, reason, malformed, count(*) as n
from (select service_date, origin, depart_hhmm, outcome, source, case when r is null then peak_queue end as peak_queue, r as reason, case when {MALFORMED} then {LINE} end as malformed from (
 select *, case when {MALFORMED} then 'wrong number of columns' when try_cast(service_date as date) is null then 'bad date' when origin not in ('A','B') then 'unknown terminal'
 when outcome not in ('boarded','waited_1','waited_2plus','cancelled') then 'unknown outcome' when depart_hhmm='5h35' then 'bad time' end as r from ({IMPORT_ROWS}))) x group by all""")
def _(b: Bound) -> DataFrame:
    path = tables.fresh_dir(b.spark, "import")
    head = "service_date,origin,depart_hhmm,outcome,peak_queue,carryover,source"
    # One file a task, each with its header, as a spreadsheet's exports are.
    lines = b.sql(f"select {LINE} as value from ({IMPORT_ROWS})")
    lines.mapInArrow(lambda batches: _with_header(batches, head), "value string").write.text(path)
    rows = imports.read_outcomes_csv(b.spark, path, head.split(","))
    ends = b.terminals.select("route", "terminal", "destination")
    records, rejects = imports.import_outcomes(rows, ends, b.params)
    good = records.select(
        F.col("service_date").cast("string").alias("service_date"), "origin", "depart_hhmm", "outcome", "filled",
        "overload", "method", "peak_queue", F.lit(None).cast("string").alias("reason"),
    )
    both = good.unionByName(rejects, allowMissingColumns=True)
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


def _with_header(batches, head: str):
    yield pa.record_batch([pa.array([head])], ["value"])
    yield from batches


# Image files of every type: a JPEG whose frame segment lies behind others of varying length (one holds false markers),
# the three forms of WEBP, PNG and GIF; every eleventh is cut after its signature.
W, H = "doc_id%1900+20", "doc_id%1000+10"


def _le(expr: str, count: int) -> str:
    return "||".join(f"printf('%02X', cast(floor(({expr})/{256 ** i}) as bigint)%256)" for i in range(count))


IMAGE = f"""case doc_id%7 when 0 then 'FFD8FFE0'||printf('%04X', 2+doc_id%40)||repeat('AB', cast(doc_id%40 as int))||'FFFFDB0006FFC0FFD9'||case when doc_id%2=0 then 'FFC0' else 'FFC2' end||'000B08'||printf('%04X', {H})||printf('%04X', {W})||'01011100'
 when 1 then '89504E470D0A1A0A0000000D49484452'||printf('%08X', {W})||printf('%08X', {H})||'0802000000' when 2 then '474946383961'||{_le(W, 2)}||{_le(H, 2)}
 when 3 then '524946460000000057454250'||case doc_id%3 when 0 then '5650382000000000000000'||'9D012A'||{_le(W, 2)}||{_le(H, 2)} when 1 then '5650384C000000002F'||{_le(f"({W}-1)+({H}-1)*16384", 4)} else '565038580A00000010000000'||{_le(f"{W}-1", 3)}||{_le(f"{H}-1", 3)} end
 when 4 then '524946460000000041564920' when 5 then '' else '3C68746D6C' end"""
FILE = f"case when doc_id%7=5 then '' when doc_id%11=0 then substr({IMAGE}, 1, case when doc_id%7=2 then 18 else 24 end) else {IMAGE}||hex(encode(text{{}})) end"


@query("src04_frame_ingest", f"""
select doc_id, case when n=0 then 'error' when k is null then 'error' else 'ok' end as status, case when k is not null then n end as bytes, case when k is not null then 'A/2024/01/'||printf('%02d', doc_id%28+1)||'/A_202401'||printf('%02d', doc_id%28+1)||'T'||printf('%02d', doc_id%24)||'0000.'||k end as path,
 case when k is not null then sha end as sha256, case when n=0 then 'empty response' when k is null then 'response was not an image (content-type=text/html)' end as error,
 case when k is not null and doc_id%11<>0 then {W} end as width, case when k is not null and doc_id%11<>0 then {H} end as height, case when k is not null and doc_id%11=0 then 'image does not state its size' end as size_error
from (select doc_id, octet_length(c) as n, sha256(c) as sha, case doc_id%7 when 0 then 'jpg' when 1 then 'png' when 2 then 'gif' when 3 then 'webp' end as k
 from (select doc_id, unhex({FILE.format("")}) as c from {{documents}}))""")
def _(b: Bound) -> DataFrame:
    # Fetched files land in a table first, as the collector leaves them.
    path = tables.fresh_dir(b.spark, "fetched")
    b.sql(f"select doc_id, unhex({FILE.format(', ' + repr('utf-8'))}) as content from {{documents}}").write.parquet(path)
    fetched = b.spark.read.schema("doc_id bigint, content binary").parquet(path).select(
        "doc_id", F.lit("A").alias("terminal"), F.lit("main").alias("camera"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(cast(doc_id % 28 as int), cast(doc_id % 24 as int))").alias("captured_at"),
        "content", F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"),
    )
    frames = fr.ingest_frames(fetched, b.params).select(
        "doc_id", "status", F.col("bytes").cast("bigint").alias("bytes"), "path", "sha256", "error",
        F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"),
    )
    named = fr.size_errors(fetched.withColumn("camera", F.col("doc_id"))).select(F.col("camera").alias("doc_id"), F.col("error").alias("size_error"))
    return frames.join(named, "doc_id", "left")


shape("o_offered", """
select case when user_id%2=0 then 'A' else 'B' end as terminal, case when user_id%5=0 then 'road' else 'main' end as camera, date_trunc('second', ts) as captured_at, bool_or(event_type<>'error') as held from {events} group by 1,2,3""")
shape("o_missing", "select *, row_number() over (partition by terminal, camera order by captured_at desc) as place from o_offered where not held")


@query("src05_replay_window_missing", """
select m.terminal, m.camera, captured_at, place > 500 as deferred, offered, already_held, capped from o_missing m join (
 select terminal, camera, count(*) as offered, count(*) filter (held) as already_held, greatest(count(*) filter (not held) - 500, 0) as capped from o_offered group by 1,2) t using (terminal, camera)""")
def _(b: Bound) -> DataFrame:
    rows = b.view("v_readings").withColumn("captured_at", F.date_trunc("second", "captured_at"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    # One published index per camera and hour, as the feeds write them, bad entries included.
    index = rows.select("terminal", "camera", "captured_at").distinct().groupBy(
        "terminal", "camera", F.date_trunc("hour", "captured_at").alias("hour")
    ).agg(F.to_json(F.array_append(F.collect_list(F.date_format("captured_at", stamp)), F.lit("not a stamp"))).alias("payload"))
    offered = listings.index_moments(index, stamp)
    fetch, totals = listings.replay_missing(offered, rows)
    return fetch.join(totals, ["terminal", "camera"])


@query("src06_newest_document_per_site", r"""
select site, lang, hour, arg_max(name, name) as name from (select *, max(hour) over (partition by site, lang) as best from (
 select regexp_extract(url, '://([^/]+)/([a-z]{2})/', 1) as site, regexp_extract(url, '://([^/]+)/([a-z]{2})/', 2) as lang, url as name, timestamp '2024-01-01' + to_hours(page_id%24) as hour from {pages}) where site<>''
 and hour between timestamp '2024-01-01 06:00:00' and timestamp '2024-01-01 18:00:00') where hour=best group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    listing = b.table("pages").select(
        F.col("url").alias("name"),
        F.timestamp_add("HOUR", (F.col("page_id") % 24).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("hour"),
    )
    now = F.lit("2024-01-01 18:00:00").cast("timestamp")
    return listings.newest_documents(listing, now, r"://([^/]+)/([a-z]{2})/")


# ---- sinks ------------------------------------------------------------------------------
@query("snk01_export_datasets", """
select service_id, scheduled, outcome, n from (select o_orderkey as service_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as scheduled, l_returnflag as outcome, count(*) as n
 from {orders} left join {lineitem} on l_orderkey=o_orderkey group by 1,2,3) where scheduled >= '1996-03-01' and scheduled <= '1999-06-30'""")
def _(b: Bound) -> DataFrame:
    frames = b.table("orders").select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_orderdate").alias("captured_at")
    )
    readings = b.table("lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_returnflag").alias("outcome"))
    out = sinks.export_dataset(
        {"frames": frames, "readings": readings}, "frames", "1996-03-01", "1999-06-30"
    )
    path = tables.fresh_dir(b.spark, "export")
    sinks.write_export(out, path, "csv")
    back = b.spark.read.option("header", True).schema("frame_id bigint, captured_at string, outcome string").csv(path)
    return back.groupBy(F.col("frame_id").alias("service_id"), F.col("captured_at").alias("scheduled"), "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


shape("o_held", """
select terminal, captured_at, min(frame_id) as frame_id from (select terminal, date_trunc('minute', captured_at) as captured_at, frame_id from v_readings where status='ok') group by 1,2
union all select terminal, null, frame_id from v_readings where status<>'ok'""")


@query("snk02_insert_or_ignore", """
select terminal, captured_at, frame_id, (select count(*) from o_held) as stored_first, (select count(*) from o_held where captured_at is null) as stored_again from o_held
union all select terminal, captured_at, frame_id + 1000000000, (select count(*) from o_held), (select count(*) from o_held where captured_at is null) from o_held where captured_at is null""")
def _(b: Bound) -> DataFrame:
    rows = b.view("v_readings").select(
        "terminal", F.when(F.col("status") == "ok", F.date_trunc("minute", "captured_at")).alias("captured_at"), "frame_id"
    )
    path, key = tables.fresh_dir(b.spark, "ignored"), ["terminal", "captured_at"]
    first = sinks.append_new(path, rows, key, ["frame_id"])
    # The same rows offered again: only those without a whole key are stored once more.
    again = sinks.append_new(path, rows.withColumn("frame_id", F.col("frame_id") + 1_000_000_000), key, ["frame_id"])
    held = b.spark.read.schema(rows.schema).parquet(path)
    return held.withColumns({"stored_first": F.lit(first).cast("bigint"), "stored_again": F.lit(again).cast("bigint")})


@query("snk03_upsert_and_replace", """
select route, origin, scheduled, case when replaced then service_id + 2000000000 else service_id end as service_id, case when replaced then 'friday' else day_type end as day_type, case when replaced then 'winter' else season end as season from (
 select *, service_id < 1000000000 and service_id%7=0 as replaced from (
  select route, origin, scheduled, service_id, case when service_id%3=0 then 'sunday_holiday' else day_type end as day_type, season from o_uniq
  union all select route, origin, scheduled + interval 1 day, service_id + 1000000000, 'saturday', 'winter' from o_uniq where service_id%5=0 and (route, origin, scheduled + interval 1 day) not in (select (route, origin, scheduled) from o_uniq)))""")
def _(b: Bound) -> DataFrame:
    key = ["route", "origin", "scheduled"]
    target = b.records.groupBy(*key).agg(
        F.min("service_id").alias("service_id"), F.first("day_type").alias("day_type"), F.first("season").alias("season")
    ).withColumn("year", F.to_date(F.date_trunc("year", "scheduled")))
    path = tables.fresh_dir(b.spark, "upserted")
    sinks.write_keyed(path, target, key, ["service_id"], partition="year")
    # Stored services change two columns, whatever else the batch says of them; new ones are added. The batch comes twice.
    changed = target.filter("service_id % 3 = 0").withColumns({"service_id": F.col("service_id") + 9, "day_type": F.lit("sunday_holiday")})
    added = target.filter("service_id % 5 = 0").select(
        "route", "origin", add_minutes(F.col("scheduled"), 1440).alias("scheduled"),
        (F.col("service_id") + 1_000_000_000).alias("service_id"), F.lit("saturday").alias("day_type"), F.lit("winter").alias("season"),
    ).withColumn("year", F.to_date(F.date_trunc("year", "scheduled"))).join(target.select(*key), key, "left_anti")
    for _again in range(2):
        sinks.write_keyed(path, changed.unionByName(added), key, ["service_id"], update=["day_type", "season"], partition="year")
    # And the form that replaces rows whole.
    other = target.filter("service_id % 7 = 0").withColumns(
        {"service_id": F.col("service_id") + 2_000_000_000, "day_type": F.lit("friday"), "season": F.lit("winter")}
    )
    sinks.write_keyed(path, other, key, ["service_id"], partition="year")
    return b.spark.read.schema(target.schema).parquet(path).drop("year")


shape("o_uniq", "select route, origin, scheduled, min(service_id) as service_id, any_value(day_type) as day_type, any_value(season) as season from o_records group by 1,2,3")

# A board, or a tracker, pasted below each page's own text.
BOARD_TAIL = """concat(html, case when page_id%9=0 then '' when page_id%9=1 then '<h2>Departures</h2><p>nothing today</p>' else concat('<h2>Departures</h2><p>5:35 am ', case page_id%4 when 0 then 'Departed 5:51 am' when 1 then 'Upcoming' when 2 then 'Cancelled' else concat('Upcoming ', cast(page_id%140 as string), '% available') end,
 '</p><p>7:25 am Upcoming ', cast(page_id%100 as string), '% full', case when page_id%6=0 then concat(repeat(' &amp; more', 60), ' to the end &#8211; all of it') else '' end, '</p><p>5:35 am Departed 5:51 am Peak travel. Loading maximum number of vehicles</p><p>Last updated: 9:25 am</p>') end)"""


def _board_pages(b: Bound) -> tuple[DataFrame, DataFrame]:
    page = b.sql(f"select page_id, 'A' as terminal, case when page_id%50=3 then '' else {BOARD_TAIL} end as html from {{pages}}")
    expected = b.blocks.filter("terminal = 'A'").select("terminal", F.explode("departures").alias("depart_hhmm")).distinct()
    return page, expected


@query("scl15_board_text_extraction", """
select page_id, '05:35' as hhmm, case when page_id%4=3 and page_id%140<=100 then page_id%140 end as percent_available, '05:51' as departed_hhmm,
 'Departed 5:51 am Peak travel. Loading maximum number of vehicles' as status_text from {pages} where page_id%9>1 and page_id%50<>3
union all select page_id, '07:25', 100 - page_id%100, null, 'Upcoming '||cast(page_id%100 as string)||'% full'||case when page_id%6=0 then repeat(' & more', 60)||' to the end – all of it' else '' end from {pages} where page_id%9>1 and page_id%50<>3""")
def _(b: Bound) -> DataFrame:
    page, expected = _board_pages(b)
    rows = pages.board_rows_from_pages(page, expected)
    return rows.select(
        "page_id", "hhmm", F.col("percent_available").cast("bigint").alias("percent_available"), "departed_hhmm", "status_text"
    )


@query("snk04_fetch_status_rows", """
select page_id, case when page_id%50=3 then 'error' when page_id%9>1 then 'ok' when page_id%9=0 then 'not_published' else 'unparsed' end as fetch_status, page_id%50<>3 and page_id%9=1 as has_raw from {pages}""")
def _(b: Bound) -> DataFrame:
    page, expected = _board_pages(b)
    rows = pages.board_rows_from_pages(page, expected)
    return pages.fetch_status(page, rows).select("page_id", "fetch_status", F.col("raw").isNotNull().alias("has_raw"))


TRACKER = """concat(html, '<table><tr><td>Vessel</td><td>Status</td><td>Heading</td><td>Last Update</td></tr><tr><td>Blue&nbsp;Star ', cast(page_id%3 as string), '</td><td>', case when page_id%2=0 then 'Stopped' else 'Under Way' end,
 '</td><td>NW</td><td>', cast(page_id%12+1 as string), ':0', cast(page_id%10 as string), case when page_id%2=0 then ' AM' else ' PM' end, '</td></tr><tr><td colspan="4">notes</td><td>x</td><td>y</td><td>z</td></tr></table><script>f("<td><b>Blue Star ', cast(page_id%3 as string),
 '</b></td><td>Heading: <b>NW</b></td><td>Speed: <b>', cast(page_id%20 as string), '.5 knots</b></td>")</script>')"""


@query("scl16_tracker_rows", """
select page_id, 'Blue Star '||cast(page_id%3 as string) as vessel, case when page_id%2=0 then 'Stopped' else 'Under Way' end as status, 'NW' as heading,
 printf('%02d:0%d', (page_id%12+1)%12 + case when page_id%2=0 then 0 else 12 end, page_id%10) as updated_hhmm, page_id%20+0.5e0 as speed_knots from {pages}""")
def _(b: Bound) -> DataFrame:
    page = b.sql(f"select page_id, {TRACKER} as html from {{pages}}")
    return pages.tracker_rows(page).filter("vessel like 'Blue Star%'").drop("place")


# ---- forecasts as documents -------------------------------------------------------------
MARINE = """concat('<marineData>', case when l_partkey%41=0 then '<broken>' else '' end, '<area> Outer   Strait </area><warnings', case when l_partkey%3=0 then case l_partkey%4 when 0 then ' name="WARNINGS"><event name="Gale warning" priority="urgent">in effect</event>' when 1 then ' title="a name=''x''"> <event priority="urgent" name="Gale"/> behind it ' when 2 then '>in  force<a type="t"><b>deep</b>tail</a>more' else ' type="storm"/><warnings>' end else '>' end, '</warnings>',
 '<regularForecast><dateTime zone="UTC"><timeStamp>', date_format(l_shipdate, 'yyyyMMdd'), '0930</timeStamp></dateTime><location name="south"><weatherCondition><wind>Wind north ', cast(cast(l_quantity as int) as string), ' knots</wind><periodOfCoverage>Today and tomorrow</periodOfCoverage></weatherCondition></location>',
 '<location name="North"><weatherCondition><wind>Wind west ', cast(l_linenumber*10 as string), ' to ', cast(l_linenumber*10+5 as string), ' knots</wind></weatherCondition></location></regularForecast>',
 '<extendedForecast><location><weatherCondition><forecastPeriod name="Thursday">Wind light</forecastPeriod><forecastPeriod name="Someday">Wind strong</forecastPeriod></weatherCondition></location></extendedForecast></marineData>')"""
DOC_ID = "concat(cast(l_orderkey as string),'-',cast(l_linenumber as string),'-',cast(l_partkey as string),'-',cast(l_suppkey as string),'-',cast(cast(floor(l_extendedprice*100+0.5) as bigint) as string))"


@query("scl18_marine_xml", f"""
select doc_id, service_date, kind, wind, wind_max_kt, case when wind_max_kt>=48 then 'storm' when wind_max_kt>=34 then 'gale' when wind_max_kt>=20 then 'strong' else 'light' end as band,
 case w when 0 then 'WARNINGS · Gale warning · urgent · in effect' when 1 then 'Gale · urgent' when 2 then 'in force · t · deep' when 3 then 'storm' end as warning, loc as location, 'Outer Strait' as area, cast(null as string) as error, count(*) as n from (
 select {DOC_ID} as doc_id, d + unnest([0,1]) as service_date, 'regular' as kind, case when north then 'Wind west '||cast(l_linenumber*10 as string)||' to '||cast(l_linenumber*10+5 as string)||' knots' else 'Wind north '||cast(q as string)||' knots' end as wind,
  case when north then l_linenumber*10+5 else q end as wind_max_kt, case when l_partkey%3=0 then l_partkey%4 end as w, case when north then 'North' else 'south' end as loc from o_marine where l_partkey%41<>0
 union all select {DOC_ID}, d + ahead, 'extended', 'Wind light', 10, case when l_partkey%3=0 then l_partkey%4 end, case when north then 'North' else 'south' end from o_marine where l_partkey%41<>0 and ahead>1) group by all
union all select {DOC_ID}, null, null, null, null, null, null, null, null, 'not well-formed XML', count(*) from o_marine where l_partkey%41=0 group by 1""")
def _(b: Bound) -> DataFrame:
    docs = b.sql(
        f"select {DOC_ID} as doc_id, case when l_suppkey%2=0 then 'NORTH ' else 'elsewhere' end as preferred, {MARINE} as xml from {{lineitem}}"
    )
    rows = marine_forecast_rows(docs, b.params)
    bad = F.col("error").isNotNull()
    return rows.groupBy(
        "doc_id", "service_date", "kind", "wind", "wind_max_kt", "band",
        F.when(~bad, F.col("warning")).alias("warning"), F.when(~bad, F.col("location")).alias("location"),
        F.when(~bad, F.col("area")).alias("area"), "error",
    ).agg(F.count(F.lit(1)).alias("n"))


shape("o_marine", """
select *, cast(l_shipdate as date) as d, l_suppkey%2=0 as north, cast(floor(l_quantity) as int) as q,
 cast(case when (4-isodow(l_shipdate)+7)%7=0 then 7 else (4-isodow(l_shipdate)+7)%7 end as int) as ahead from {lineitem}""")
SHORE = """concat('<siteData><location><name>Some Town</name><region>Coast</region></location><forecastGroup><dateTime zone="UTC"><timeStamp>', date_format(l_shipdate, 'yyyyMMdd'), '180000</timeStamp></dateTime><dateTime zone="PST"><timeStamp>', date_format(l_shipdate, 'yyyyMMdd'), '100000</timeStamp></dateTime>',
 '<forecast><period textForecastName="Today">x</period><textSummary>Sunny  spells.</textSummary><abbreviatedForecast><textSummary>Sunny</textSummary><pop units="%">', cast(l_linenumber*10 as string), '</pop></abbreviatedForecast><temperatures><temperature class="high">', cast(cast(l_quantity as int) as string), '</temperature></temperatures></forecast>',
 '<forecast><period textForecastName="Thursday night">x</period><textSummary>Rain.</textSummary><abbreviatedForecast><textSummary>Rain</textSummary><pop units="%"></pop></abbreviatedForecast><temperatures><temperature class="low">3</temperature></temperatures></forecast></forecastGroup></siteData>')"""


@query("scl20_shore_xml", f"""
select doc_id, service_date, kind, period, condition, pop, temp_high, temp_low, summary, count(*) as n from (
 select {DOC_ID} as doc_id, d as service_date, 'day' as kind, 'Today' as period, 'Sunny' as condition, l_linenumber*10 as pop, q as temp_high, cast(null as int) as temp_low, 'Sunny spells.' as summary from o_marine
 union all select {DOC_ID}, d + ahead, 'night', 'Thursday night', 'Rain', null, null, 3, 'Rain.' from o_marine) group by all""")
def _(b: Bound) -> DataFrame:
    docs = b.sql(f"select {DOC_ID} as doc_id, {SHORE} as xml from {{lineitem}}")
    rows = shore_forecast_rows(docs)
    key = ["doc_id", "service_date", "kind", "period", "condition", "pop", "temp_high", "temp_low", "summary"]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


# ---- forecasts in force -----------------------------------------------------------------
shape("o_fc", """
select cast(site as string) as site, route, service_date, cast(issued_on as timestamp) + to_minutes(issue_seq%1440) as issued_at, kind, wind_max_kt, case when ok then 'ok' else 'error' end as fetch_status,
 case when wind_max_kt is null then 'unknown' when wind_max_kt>=48 then 'storm' when wind_max_kt>=34 then 'gale' when wind_max_kt>=20 then 'strong' else 'light' end as band, issue_seq, l_orderkey, l_linenumber, cents from v_forecasts""")


@query("top06_forecast_in_force", """
select site, service_date, issued_at, kind, wind_max_kt, band, h as stale_hours, h>=24 as stale, service_date<>cast(issued_at as date) as carried_over,
 case when h<1 then 'issued in the last hour' when h<48 then 'issued '||cast(h as string)||' h ago' else 'issued '||cast(h//24 as string)||' days ago' end as issued_label from (
 select *, cast(greatest(0, floor(epoch(timestamp '1998-06-15 12:00:00'-issued_at)/3600)) as int) as h from o_fc where fetch_status='ok'
 qualify row_number() over (partition by site, service_date order by issued_at desc, (kind='regular') desc, l_orderkey desc, l_linenumber desc, cents desc)=1)""")
def _(b: Bound) -> DataFrame:
    now = F.lit("1998-06-15 12:00:00").cast("timestamp")
    found = forecast.forecast_in_force(
        b.forecasts, ["site", "service_date"], "regular", now, b.params, ["l_orderkey", "l_linenumber", "cents"]
    )
    return found.select(
        "site", "service_date", "issued_at", "kind", "wind_max_kt", "band", "stale_hours", "stale", "carried_over", "issued_label"
    )


@query("agg28_wind_band_record", """
select t.route, t.band, t.service_date, count(*) as days, min(d.service_date) as since, cast(sum(d.n) as bigint) as sailings, cast(sum(d.c) as bigint) as cancelled from o_band_days t join o_band_days d on d.route=t.route and d.band=t.band and d.service_date<t.service_date
group by 1,2,3 having sum(d.n)>0 and (sum(d.c)>0 or count(*)>=20)""")
def _(b: Bound) -> DataFrame:
    return forecast.band_records(b.forecasts, b.records, b.params)


shape("o_band_days", """
select f.*, coalesce(n,0) as n, coalesce(c,0) as c from (select distinct route, band, service_date from o_fc where fetch_status='ok' and band<>'unknown') f
left join (select route, service_date, count(*) as n, count(*) filter (outcome='cancelled') as c from o_records where outcome<>'unknown' group by 1,2) r using (route, service_date)""")


@query("set03_forecast_precedence_union", """
select site, service_date, kind, count(*) as n from o_fc f where fetch_status='ok' and (kind='regular' or not exists (select 1 from o_fc r where r.kind='regular' and r.fetch_status='ok' and r.site=f.site and r.service_date=f.service_date)) group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    good = b.forecasts.filter("fetch_status = 'ok'")
    days = forecast.precedence_union(
        good.filter("kind = 'regular'"), good.filter("kind = 'extended'"), ["site", "service_date"]
    )
    return days.groupBy("site", "service_date", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---- retention --------------------------------------------------------------------------
@query("win07_keep_n_per_hour", """
select frame_id, captured_at, place from (select *, row_number() over (partition by terminal, camera, date_trunc('hour', captured_at) order by captured_at, frame_id) as place from o_frames
 where path is not null and version in ('model','extent') and captured_at < timestamp '2024-05-15' - interval 120 day and captured_at >= timestamp '2024-05-15' - interval 400 day) where place>1""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-05-15").cast("timestamp")
    return retention.hourly_surplus(b.frames, b.readings, now, b.params).select("frame_id", "captured_at", "place")


@query("win08_expired_frames", """
select frame_id, version in ('model','extent') as expired from o_frames where path is not null and captured_at < timestamp '2025-02-20' - interval 400 day""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2025-02-20").cast("timestamp")
    same = Params(zone="UTC", thin_after_days=b.params.keep_days)
    gone = retention.expired_frames(b.frames, b.readings, now, b.params).select("frame_id", F.lit(True).alias("expired"))
    held = retention.held_back_frames(b.frames, b.readings, now, same).select("frame_id", F.lit(False).alias("expired"))
    return gone.unionByName(held)


@query("win09_thin_unread", """
select frame_id from o_main where version<>'model' and captured_at < timestamp '2024-03-01' - interval 45 day and frame_id not in (select frame_id from o_nearest)""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-03-01").cast("timestamp")
    return retention.thinned_unread(b.frames, b.readings, b.services, now, b.params).select("frame_id")


# ---- health -----------------------------------------------------------------------------
@query("agg16_observed_range", """
select min(d) as first_day, max(d) as last_day from (select cast(captured_at as date) as d from o_frames where status='ok' union all select service_date from o_board where fetch_status='ok')""")
def _(b: Bound) -> DataFrame:
    return quality.observed_range(b.frames, b.board, b.params)


# Three set-ups: polled cameras with a stale and a current feed; none configured and an unread feed; cameras asked on demand.
shape("o_setup", """
select * from (values ('polled', 2, true, timestamp '1998-06-15 12:00:00', timestamp '2024-01-29 20:00:00'), ('bare', 0, true, null, timestamp '2024-01-29 20:00:00'), ('on demand', 2, false, timestamp '2024-01-29 13:00:00', timestamp '2024-01-29 11:00:00')) as t(setup, cameras, polls, marine_at, shore_at)""")
shape("o_health", """
select *, round(captures/nullif(case when polls then 2016*greatest(cameras,1) else 0 end,0),4) as capture_rate, round(bok/btot,4) as board_rate, round(with_record/services,4) as coverage, round(micros/1e6,4) as month_spend
from (select count(*) filter (status='ok' and captured_at>=timestamp '2024-01-23') as captures, count(*) filter (status='error' and captured_at>=timestamp '2024-01-23') as failed, max(captured_at) filter (status='ok') as last_capture_at, count(*) filter (status='ok' and version<>'model') as awaiting,
  count(*) filter (status='ok' and version='model') as rd, count(*) filter (status='ok' and version='model' and not usable) as unusable from o_frames)
cross join (select count(*) as btot, count(*) filter (fetch_status='ok') as bok, count(*) filter (fetch_status='ok') as busable from o_board where observed_at>=timestamp '2024-01-23')
cross join (select count(*) as services, count(*) filter (coalesce(b.outcome,'unknown')<>'unknown') as with_record from o_services left join o_board_class b using (origin, service_date, depart_hhmm) where o_services.service_date between date '2024-01-23' and date '2024-01-30')
cross join (select sum(cast(k*40*3+k*15 as bigint)) as micros from e where ts>=timestamp '2024-01-01' and ts<=timestamp '2024-01-30 00:00:00')
cross join o_setup""")


@query("agg19_capture_health", """
select setup, captures, failed, capture_rate, board_rate, busable as board_usable, awaiting, round(unusable/rd,4) as unusable_share, services, with_record, coverage, last_capture_at, month_spend,
 concat_ws('; ', case when polls and cameras=0 then 'no cameras are configured' end, case when capture_rate<0.95 then 'captures at '||cast(cast(floor(capture_rate*100+0.5) as int) as string)||'%' end,
  case when polls and timestamp '2024-01-30 00:00:00' - last_capture_at > interval 20 minute then 'no capture since '||strftime(last_capture_at,'%Y-%m-%dT%H:%M:%SZ') end, case when polls and awaiting>800 then cast(awaiting as string)||' frames wait to be read' end,
  case when board_rate<0.95 then 'board at '||cast(cast(floor(board_rate*100+0.5) as int) as string)||'%' end, case when month_spend>4.5 then 'near the budget' end, case when coverage<0.9 then 'records for '||cast(cast(floor(coverage*100+0.5) as int) as string)||'%' end,
  case when marine_at is null then 'no marine forecast has been read yet' when timestamp '2024-01-30 00:00:00' - marine_at > interval 12 hour then 'the marine forecast is stale, last issued '||strftime(marine_at,'%Y-%m-%dT%H:%M:%SZ') end,
  case when shore_at is null then 'no shore forecast has been read yet' when timestamp '2024-01-30 00:00:00' - shore_at > interval 12 hour then 'the shore forecast is stale, last issued '||strftime(shore_at,'%Y-%m-%dT%H:%M:%SZ') end) as problems
from o_health""")
def _(b: Bound) -> DataFrame:
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    known = _known_services(b).select(*KEY, F.col("deck_outcome").alias("outcome"))
    services = b.services.join(known, KEY, "left").select("service_date", "outcome")
    spent = b.view("e").select(
        F.col("ts").alias("created_at"), (spend.cost_micros(F.col("k") * 40, F.col("k"), b.params) / 1e6).alias("cost_usd")
    )
    # One issue a frame error, with the set-up's stamp as the newest good one.
    errors = b.frames.filter("status = 'error'").select(F.col("captured_at").alias("issued_at"), F.lit("error").alias("fetch_status"))

    def feed(stamp: str | None) -> DataFrame:
        if stamp is None:
            return errors
        return errors.unionByName(b.spark.sql(f"select timestamp'{stamp}' as issued_at, 'ok' as fetch_status"))

    out = None
    for name, cameras, polls, marine, shore in (
        ("polled", 2, True, "1998-06-15 12:00:00", "2024-01-29 20:00:00"), ("bare", 0, True, None, "2024-01-29 20:00:00"),
        ("on demand", 2, False, "2024-01-29 13:00:00", "2024-01-29 11:00:00"),
    ):
        report = quality.capture_totals(
            b.frames, b.board, b.readings, services, spent, now, replace(b.params, scheduled_capture=polls), window_days=7,
            cameras=cameras, forecasts={"marine": feed(marine), "shore": feed(shore)},
        ).select(
            F.lit(name).alias("setup"), "captures", "failed", "capture_rate", "board_rate", "board_usable", "awaiting", "unusable_share", "services",
            "with_record", "coverage", "last_capture_at", "month_spend", F.array_join("problems", "; ").alias("problems"),
        )
        out = report if out is None else out.unionByName(report)
    return out


@query("agg20_capture_strip", """
select d as service_date, coalesce(ok,0) as ok, coalesce(failed,0) as failed, coalesce(unusable,0) as unusable, case when coalesce(ok,0)<0.5*200 then 'bad' when coalesce(failed,0)>0 or coalesce(unusable,0)>0 then 'degraded' when ok>0 then 'good' else 'none' end as state
from (select cast(unnest(generate_series(timestamp '2024-01-20', timestamp '2024-02-02', interval 1 day)) as date) as d) left join (
 select service_date as d, count(*) filter (status='ok') as ok, count(*) filter (status='error') as failed, count(*) filter (status='ok' and version='model' and not usable) as unusable from o_frames group by 1) using (d)""")
def _(b: Bound) -> DataFrame:
    days = b.spark.sql("select explode(sequence(date'2024-01-20', date'2024-02-02')) as service_date")
    return quality.capture_strip(b.frames, b.readings, days, b.params, expected=200)


shape("o_reads", """
select *, cast(l_shipdate as date) as day, cast(floor(l_extendedprice/100) as bigint)*3 + cast(floor(l_quantity) as bigint)*15 as micros, l_orderkey//100 as block from {lineitem}""")


def _reads(b: Bound) -> DataFrame:
    return b.table("lineitem").select(
        F.col("l_shipdate").alias("created_at"), F.to_date("l_shipdate").alias("day"),
        F.date_trunc("month", "l_shipdate").alias("month"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.floor(F.col("l_orderkey") / 1000).alias("block"), F.floor(F.col("l_partkey") / 100).alias("parts"), "l_extendedprice",
        spend.cost_micros(F.floor(F.col("l_extendedprice") / 100), F.floor("l_quantity"), b.params).alias("cost_micros"),
    )


@query("agg21_month_spend", """
select day, reads, micros/1e6 as day_usd, sum(micros) over (partition by date_trunc('month', day) order by day)/1e6 as month_usd, greatest(20 - reads, 0) as frames_left from (select day, count(*) as reads, sum(micros) as micros from o_reads group by 1)""")
def _(b: Bound) -> DataFrame:
    return spend.daily_spend(_reads(b), Params(zone="UTC", daily_frame_cap=20))


# The processing order, coarse to fine; even one order holding most rows is split by its lines and parts.
LEVELS = ["month", "day", "block", "l_orderkey", "l_linenumber", "parts"]


@query("str07_budget_stop", """
select day, offered, coalesce(read, 0) as read, coalesce(micros, 0) as micros, most_spent_before, offered > 20 as day_full, coalesce(read, 0) < least(offered, 20) as month_spent from (select day, count(*) as offered from o_reads group by 1) left join (
 select day, count(*) as read, cast(sum(micros) as bigint) as micros, cast(max(spent_before) as bigint) as most_spent_before from (
  select *, coalesce(sum(micros) over (partition by date_trunc('month', day) order by day, l_orderkey, l_linenumber, l_partkey, l_suppkey, micros, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as spent_before from (
   select * from o_reads qualify row_number() over (partition by day order by l_orderkey, l_linenumber, l_partkey, l_suppkey, micros, l_extendedprice) <= 20)) where spent_before < 500000 group by 1) using (day)""")
def _(b: Bound) -> DataFrame:
    limits = Params(zone="UTC", monthly_budget_usd=0.5, daily_frame_cap=20)
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cost_micros", "l_extendedprice")]
    kept = spend.admitted(_reads(b), LEVELS, order, limits).groupBy("day").agg(
        F.count(F.lit(1)).alias("read"), F.sum("cost_micros").alias("micros"), F.max("spent_before").alias("most_spent_before")
    )
    offered = _reads(b).groupBy("day").agg(F.count(F.lit(1)).alias("offered"))
    read, cap = F.coalesce("read", F.lit(0)), limits.daily_frame_cap
    return offered.join(kept, "day", "left").select(
        "day", "offered", read.alias("read"), F.coalesce("micros", F.lit(0)).alias("micros"), "most_spent_before",
        (F.col("offered") > cap).alias("day_full"), (read < F.least("offered", F.lit(cap))).alias("month_spent"),
    )


@query("top02_latest_observation", """
select terminal, camera, frame_id, captured_at, vehicle_count, usable from o_readings where version='model' qualify row_number() over (partition by terminal, camera order by captured_at desc, frame_id desc)=1""")
def _(b: Bound) -> DataFrame:
    latest = quality.latest_reading(b.readings, b.params.model_version, ["terminal", "camera"])
    return latest.select("terminal", "camera", "frame_id", "captured_at", "vehicle_count", "usable")


@query("agg22_calibration_coverage", """
select * from (select terminal, count(*) as frames, count(*) filter (version='model') as observed, count(*) filter (version='model' and usable) as usable from o_readings group by 1) join (
 select terminal, string_agg(reason||'='||cast(n as string), ',' order by reason) as reasons from (select terminal, case when frame_id%3=0 then 'dark' when frame_id%3=1 then 'obscured' else 'unknown' end as reason, count(*) as n from o_readings where version='model' and not usable group by 1,2) group by 1) using (terminal)
join (select origin as terminal, count(*) as services, count(*) filter (coalesce(b.outcome,'unknown')<>'unknown') as with_outcome from o_services left join o_board_class b using (origin, service_date, depart_hhmm) group by 1) using (terminal)""")
def _(b: Bound) -> DataFrame:
    seen = b.readings.withColumn(
        "visibility", F.when(F.col("frame_id") % 3 == 0, "dark").when(F.col("frame_id") % 3 == 1, "obscured")
    )
    version = b.params.model_version
    reasons = quality.unusable_reasons(seen, version).groupBy("terminal").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("reason", F.lit("="), F.col("n").cast("string")))), ",").alias("reasons")
    )
    known = _known_services(b).withColumn("outcome", F.col("deck_outcome"))
    services = quality.service_coverage(b.services, known).withColumnRenamed("origin", "terminal")
    return quality.reading_coverage(b.frames, seen, version).join(reasons, "terminal").join(services, "terminal")


shape("o_counted", "select * from o_usable where vehicle_count is not null")
shape("o_drops", """
select s.route, s.origin, s.service_date, s.depart_hhmm, any_value(b.board_departed_at) as departed_at, max(f.vehicle_count) filter (f.captured_at between s.scheduled - interval 120 minute and s.scheduled) as before,
 arg_min(f.vehicle_count, (f.captured_at, f.frame_id)) filter (f.captured_at between b.board_departed_at + interval 12 minute and b.board_departed_at + interval 45 minute) as after
from o_services s join o_board_sum b using (origin, service_date, depart_hhmm) left join o_counted f on f.terminal=s.origin and f.captured_at between s.scheduled - interval 3 hour and s.scheduled + interval 3 hour where b.board_departed_at is not null group by 1,2,3,4""")
shape("o_dropped", "select *, case when before<>0 then round(after/before,4) end as ratio, case when before is not null then after <= greatest(2, 0.5*before) end as dropped from o_drops")


def _drops(b: Bound) -> DataFrame:
    return quality.departure_drops(b.services, b.readings, brd.board_departures(b.board, b.params), b.params)


@query("agg23_departure_drop", f"select {KEYS}, departed_at, before, after, ratio, dropped from o_dropped")
def _(b: Bound) -> DataFrame:
    return _drops(b)


shape("o_trend", """
select route, origin, service_date, depart_hhmm, count(*) as n, sum((rx-mx)*(ry-my)) / nullif(sqrt(sum((rx-mx)*(rx-mx))*sum((ry-my)*(ry-my))),0) as rho from (
 select *, avg(rx) over k as mx, avg(ry) over k as my from (
  select route, origin, s.service_date, depart_hhmm, rank() over (k order by f.captured_at) + (count(*) over (partition by route, origin, s.service_date, depart_hhmm, f.captured_at)-1)/2.0 as rx,
   rank() over (k order by f.vehicle_count) + (count(*) over (partition by route, origin, s.service_date, depart_hhmm, f.vehicle_count)-1)/2.0 as ry
  from o_services s join o_counted f on f.terminal=s.origin and f.captured_at between s.scheduled - interval 120 minute and s.scheduled window k as (partition by route, origin, s.service_date, depart_hhmm))
 window k as (partition by route, origin, service_date, depart_hhmm)) group by 1,2,3,4 having count(*)>=3""")
shape("o_steps", """
select terminal, frame_id, abs(vehicle_count - lag(vehicle_count) over w) as step, epoch(captured_at - lag(captured_at) over w) as gap_seconds from o_counted window w as (partition by terminal order by captured_at, frame_id)""")


@query("win06_step_noise", "select terminal, frame_id, step, gap_seconds from o_steps where gap_seconds>0 and gap_seconds<=1500")
def _(b: Bound) -> DataFrame:
    counted = b.readings.filter("usable and vehicle_count is not null")
    return quality.reading_steps(counted, ["terminal"]).select("terminal", "frame_id", "step", "gap_seconds")


@query("agg25_calibration_scores", """
select terminal as scope, count(*) as n, round(count(*) filter (step<=20)/count(*),4) as score, cast(median(step) as double) as middle from o_steps where gap_seconds>0 and gap_seconds<=1500 group by 1
union all select 'trends', count(*), round(count(*) filter (rho>0.3)/count(rho),4), round(median(round(rho,9)),4) from o_trend
union all select 'drops', count(*), round(count(*) filter (dropped)/count(dropped),4), null from o_dropped""")
def _(b: Bound) -> DataFrame:
    counted = b.readings.filter("usable and vehicle_count is not null")
    noise = quality.noise_scores(quality.reading_steps(counted, ["terminal"]), ["terminal"])
    trends = quality.trend_scores(quality.service_trends(b.services, b.readings, b.params))
    drops = quality.drop_scores(_drops(b))
    return (
        noise.select(F.col("terminal").alias("scope"), F.col("steps").alias("n"), F.col("noise_score").alias("score"), F.col("median_step").alias("middle"))
        .unionByName(trends.select(F.lit("trends").alias("scope"), F.col("trends").alias("n"), F.col("trend_score").alias("score"), F.col("median_rho").alias("middle")))
        .unionByName(drops.select(F.lit("drops").alias("scope"), F.col("drops").alias("n"), F.col("drop_score").alias("score"), F.lit(None).cast("double").alias("middle")))
    )


# ---- set operations ---------------------------------------------------------------------
@query("set01_evidence_union", """
select d as service_date, day_type, season, bool_or(src='events') as in_events, bool_or(src='orders') as in_orders from (
 select cast(ts as date) as d, 'events' as src from {events} union select cast(o_orderdate as date), 'orders' from {orders}) join o_cal using (d) group by 1,2,3""")
def _(b: Bound) -> DataFrame:
    dated = b.event_days.withColumn("src", F.lit("events")).unionByName(
        b.table("orders").select(F.to_date("o_orderdate").alias("service_date"), F.lit("orders").alias("src"))
    ).distinct()
    day = F.col("service_date")
    return dated.groupBy("service_date").agg(
        F.bool_or(F.col("src") == "events").alias("in_events"), F.bool_or(F.col("src") == "orders").alias("in_orders")
    ).withColumns({"day_type": day_type(day), "season": season(day)})


@query("set02_set_difference", """
select distinct user_id, cast(ts as date) as d from {events} where event_type<>'error' except select user_id, cast(ts as date) from {events} where event_type='error'""")
def _(b: Bound) -> DataFrame:
    day = b.table("events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    failed = day.filter("event_type = 'error'").select("user_id", "d").distinct()
    return day.filter("event_type <> 'error'").select("user_id", "d").distinct().join(failed, ["user_id", "d"], "left_anti")
