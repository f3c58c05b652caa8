"""Sources, sinks, documents, pixels and streams on small inputs."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewait.functions.requests import classify_requests
from tidewait.functions.text import decode_references
from tidewait.operators import ledger, pixels
from tidewait.params import Params
from tidewait.sources import forecast_xml, frames, imports, listings, pages, sinks, timetable
from tidewait.streaming import feeds

P = Params(zone="UTC")


def png(width: int, height: int, grey: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + grey[y * width:(y + 1) * width] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_real_image_files_are_ingested_and_decoded(spark):
    folder = tempfile.mkdtemp(prefix="tidewait-img-")
    grey = bytes(range(12))
    with open(f"{folder}/a.png", "wb") as out:
        out.write(png(4, 3, grey))
    with open(f"{folder}/b.png", "wb") as out:
        out.write(b"<html>not an image</html>")
    files = frames.read_image_files(spark, folder).select(
        F.lit("S").alias("terminal"), F.lit("road").alias("camera"),
        F.lit("2026-07-10 08:30:05").cast("timestamp").alias("captured_at"), "content",
        F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"),
    )
    got = {r.status: r for r in frames.ingest_frames(files, P).collect()}
    ok, bad = got["ok"], got["error"]
    assert (ok.width, ok.height) == (4, 3) and ok.path == "S_road/2026/07/10/S_road_20260710T083005.png"
    assert bad.path is None and bad.error == "response was not an image (content-type=text/html)"
    image = spark.read.format("image").option("dropInvalid", True).load(folder)
    shown = pixels.luma_frames(image).first()
    assert (shown.width, shown.height, list(shown.pixels)) == (4, 3, list(grey))


def test_timetable_rejects(spark):
    raw = spark.createDataFrame(
        [(1, "S", None, date(2026, 1, 1), date(2026, 2, 1), ["Mondays", " tue"], ["9:05", "08:00"]),
         (2, "S", None, date(2026, 1, 1), date(2026, 2, 1), None, ["08:00"]),
         (3, "S", None, date(2026, 1, 1), date(2026, 2, 1), ["noday"], ["08:00"]),
         (4, "S", None, date(2026, 1, 1), date(2026, 2, 1), [], ["08:00"]),
         (5, "S", None, date(2026, 1, 1), date(2026, 2, 1), ["all"], []),
         (6, "S", None, date(2026, 1, 1), date(2026, 2, 1), ["all"], ["25:00"])],
        "block_no int, terminal string, route string, effective_from date, effective_to date, days array<string>, departures array<string>",
    )
    blocks, rejects = timetable.timetable_blocks(raw)
    got = {r.block_no: (r.days, r.departures) for r in blocks.collect()}
    assert got == {1: ([0, 1], ["08:00", "09:05"]), 2: (list(range(7)), ["08:00"])}
    assert {r.block_no: r.reason for r in rejects.collect()} == {
        3: "unrecognised day", 4: "empty day list", 5: "no departures", 6: "bad departure time"}


def test_csv_import_refuses_by_row(spark):
    path = tempfile.mkdtemp(prefix="tidewait-csv-") + "/in.csv"
    with open(path, "w") as out:
        out.write("service_date,origin,depart_hhmm,outcome,peak_queue\n2026-07-03,S,08:30,waited_1,40\n"
                  "2026-07-03,S,09:30,filled,\n2026-13-03,S,08:30,boarded,\n2026-07-03,Q,08:30,boarded,\n"
                  "2026-07-03,S\n2026-07-03,S,08:30,boarded,1,2,3\n\"2026-07-03\",S,10:30,boarded,\n")
    ends = spark.createDataFrame([("r", "S", "E")], "route string, terminal string, destination string")
    records, rejects = imports.import_outcomes(imports.read_outcomes_csv(spark, path), ends, P)
    good = records.collect()
    assert sorted((r.outcome, r.filled, r.left_behind, r.overload, r.method, r.peak_queue) for r in good) == [
        ("boarded", False, False, False, "import:manual", None), ("waited_1", True, True, True, "import:manual", 40)]
    assert sorted((r.reason, r.malformed) for r in rejects.collect()) == [
        ("bad date", None), ("unknown outcome", None), ("unknown terminal", None),
        ("wrong number of columns", "2026-07-03,S"), ("wrong number of columns", "2026-07-03,S,08:30,boarded,1,2,3")]


def test_rows_with_a_missing_key_part_are_never_merged(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7), (4, None, 7)], "id int, k string, v int")
    stored = sinks.new_rows(None, rows, ["k"], ["id"])
    assert sorted(r.id for r in stored.collect()) == [1, 3, 4]
    assert sorted(r.id for r in sinks.new_rows(stored, rows, ["k"], ["id"]).collect()) == [3, 4]


def test_a_newer_row_of_one_key_wins_whole(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 7)], "k int, v string, n int")
    got = sinks.insert_or_replace(old, new, ["k"]).collect()
    assert sorted(tuple(r) for r in got if r.v) == [(1, "a", 5), (3, "c", 7)]
    assert [tuple(r) for r in got if not r.v] == [(2, None, 9)]


def test_overwriting_dates_is_idempotent_and_leaves_other_dates(spark):
    path = tempfile.mkdtemp(prefix="tidewait-out-") + "/t"
    first = spark.createDataFrame([(date(2026, 7, 1), 1), (date(2026, 7, 2), 2)], "service_date date, v int")
    sinks.overwrite_dates(first, path)
    again = spark.createDataFrame([(date(2026, 7, 2), 9)], "service_date date, v int")
    for _ in range(2):
        sinks.overwrite_dates(again, path)
    assert {(r.service_date.day, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9)}


def test_a_date_only_bound_leaves_out_that_days_timestamps(spark):
    df = sinks.as_text(spark.createDataFrame([(datetime(2026, 6, 30, 9),), (datetime(2026, 6, 29, 9),)], "at timestamp"))
    assert [r[0] for r in sinks.bounded(df, "at", None, "2026-06-30").collect()] == ["2026-06-29T09:00:00Z"]


def test_a_failed_frame_is_fetched_again_and_the_cap_keeps_the_newest(spark):
    t0 = datetime(2026, 7, 1)
    offered = spark.createDataFrame([("S", "road", t0 + timedelta(minutes=15 * i)) for i in range(10)], "terminal string, camera string, captured_at timestamp")
    held = offered.withColumn("status", F.when(F.minute("captured_at") == 0, "ok").otherwise("error"))
    fetch, totals = listings.replay_missing(offered, held, limit=3)
    assert sorted((r.captured_at - t0).seconds // 900 for r in fetch.collect() if not r.deferred) == [6, 7, 9]
    assert sorted((r.captured_at - t0).seconds // 900 for r in fetch.collect() if r.deferred) == [1, 2, 3, 5]
    assert tuple(totals.select("offered", "already_held", "capped").first()) == (10, 3, 4)


def board_page(body: str) -> str:
    return f"<html><script>var x='7:25 am';</script><nav>Departures &amp; arrivals</nav><h2>Departures</h2>{body}<footer>Last updated: 12:20 pm Cancelled Sailings</footer></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>7:25 am Departed 7:31 am</p><p>Arrived: 8:20 am</p><p>9:25 am Upcoming</p>",
         {"07:25": (None, "07:31", "Departed 7:31 am Arrived: 8:20 am"), "09:25": (None, None, "Upcoming")}),
        ("<p>7:25 am Upcoming 45% full</p>", {"07:25": (55, None, "Upcoming 45% full")}),
        ("<p>7:25 am Upcoming 45% space available</p>", {"07:25": (45, None, "Upcoming 45% space available")}),
        ("<p>7:25 am Canceled 30%</p>", {"07:25": (None, None, "cancelled")}),
        ("<p>6:00 am Departed 6:01 am</p>", {}),
        ("<p>7:25 am Upcoming 20% full</p><p>7:25 am Peak travel. Loading maximum number of vehicles</p>",
         {"07:25": (80, None, "Peak travel. Loading maximum number of vehicles")}),
    ],
)
def test_board_pages(spark, body, want):
    page = spark.createDataFrame([(1, "S", board_page(body))], "page_id int, terminal string, html string")
    times = spark.createDataFrame([("S", "07:25"), ("S", "09:25")], "terminal string, depart_hhmm string")
    got = {r.hhmm: (r.percent_available, r.departed_hhmm, r.status_text) for r in pages.board_rows_from_pages(page, times).collect()}
    assert got == want


def test_marine_documents_that_cannot_be_read_become_rows(spark):
    good = ("<m><area>A</area><warnings/><regularForecast><dateTime zone='UTC'><timeStamp>202608130930</timeStamp></dateTime>"
            "<location name='N'><weatherCondition><wind>Wind west 20 knots</wind></weatherCondition></location></regularForecast></m>")
    docs = spark.createDataFrame(
        [("good", good, None), ("doctype", "<!DOCTYPE x>" + good, None), ("broken", good[:80], None),
         ("undated", good.replace("UTC", "PDT"), None)],
        "doc_id string, xml string, preferred string",
    )
    got = {}
    for r in forecast_xml.marine_forecast_rows(docs, P).collect():
        got.setdefault(r.doc_id, []).append((r.service_date, r.band, r.fetch_status, r.error))
    assert got["good"] == [(date(2026, 8, 13), "strong", "ok", None), (date(2026, 8, 14), "strong", "ok", None)]
    assert {k: v[0][2:] for k, v in got.items() if k != "good"} == {
        "doctype": ("error", "document declares a DOCTYPE; refusing to parse"),
        "broken": ("error", "not well-formed XML"), "undated": ("error", "no UTC issue time in the document")}


def test_vehicles_on_flat_ground_and_a_short_queue(spark):
    rows = [(i, [(r, 1.0 if r > 40 - i else 0.0) for r in range(64)]) for i in (0, 20)]
    df = spark.createDataFrame(rows, "id int, row_shares array<struct<row:int,share:double>>").select(
        "*", F.lit(4).alias("far_row"), F.lit(60.0).alias("camera_row"), F.lit(-10.0).alias("horizon"), F.lit(500.0).alias("station_scale"))
    got = {r.id: r for r in pixels.extent_reading(df).collect()}
    for r in got.values():
        seen = hits = 0
        tail = None
        for row, share in sorted(dict(rows[0 if r.id == 0 else 1][1]).items(), reverse=True):
            seen, hits = seen + 1, hits + (share > 0.6)
            if seen >= 8 and hits / seen >= 0.7:
                tail = row
        assert r.tail == tail
        assert r.vehicles == pytest.approx(500 / (tail + 10) - 500 / 70)


def test_streamed_departures_match_the_batch_whatever_the_order(spark):
    base = datetime(2026, 7, 10, 5)
    words = ["Stopped", "???", "Under Way", "Stopped", "Under Way", "Under Way", "Stopped", "Under Way"] * 6
    data = [("r", "V", base + timedelta(minutes=7 * i), w, None, i) for i, w in enumerate(words)]
    schema = "route string, vessel string, reported_at timestamp, status string, speed_knots double, row_id int"
    folder, out = (tempfile.mkdtemp(prefix="tidewait-str-") for _ in range(2))
    # Three files whose contents overlap in time by less than the delay.
    for n, part in enumerate((data[0:18:2] + data[1:18:2], data[18:36][::-1], data[36:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/f{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    feeds.write_available(
        feeds.departure_detection(stream, "3 hours", P), f"{out}/rows", f"{out}/progress"
    ).awaitTermination()
    got = {r.moment for r in spark.read.parquet(f"{out}/rows").collect()}
    whole = spark.createDataFrame(data, schema).withColumn("d", F.to_date("reported_at"))
    limit = max(r[2] for r in data) - timedelta(hours=3)
    want = {r.reported_at for r in ledger.transitions(whole, ["d"]).collect() if r.reported_at <= limit}
    assert got == want and len(want) > 5


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ('<a><warnings name="Gale warning"/></a>', "Gale warning"),
        ("<a><warnings><event name='Gale warning'/></warnings></a>", "Gale warning"),
        ('<a><warnings><event name="Wind &gt; 34 &amp; rising"/></warnings></a>', "Wind > 34 & rising"),
        ('<a><warnings>\n <event type="x" priority="urgent"> In  effect </event><!-- no <b>note</b> --></warnings><wind>y</wind></a>', "x · urgent · In effect"),
        ('<a><warnings><event priority="urgent" name="Gale"/> behind </warnings></a>', "Gale · urgent"),
        ("<a><warnings>in <b>deep</b> tail<c/>more</warnings></a>", "in · deep"),
        ("""<a><warnings note="name='no'"><x event='e' type="t">w</x></warnings></a>""", "t · e · w"),
        ("<a><warnings><![CDATA[Storm]]></warnings></a>", "Storm"), ("<a><warnings/></a>", None), ("<a><warnings></warnings></a>", None), ("<a/>", None),
    ],
)
def test_a_warning_is_never_read_as_empty(spark, xml, want):
    assert spark.createDataFrame([(xml,)], "xml string").select(forecast_xml.warning_text(F.col("xml"))).first()[0] == want


def test_a_doctype_is_refused_wherever_the_prolog_has_it(spark):
    long = "<!-- " + "x" * 5000 + " -->"
    texts = [f'<?xml version="1.0"?>{long}<!DOCTYPE a []><a/>', f"{long}<a>{'y' * 3000}&lt;!DOCTYPE</a>", "<a><![CDATA[<!DOCTYPE x>]]></a>"]
    got = spark.createDataFrame([(t,) for t in texts], "xml string").select(F.col("xml").rlike(forecast_xml.DOCTYPE)).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_references_are_decoded_once(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&eacute;&#233;&#xE9;": "ééé", "&nosuch; &#0; &": "&nosuch; &#0; &", "&apos;&quot;": "'\"", "&#128674;": "\U0001f6a2", "plain": "plain"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select(decode_references(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_long_texts_are_kept_whole(spark):
    note = " ".join(["Loading maximum number of vehicles"] * 200)
    page = spark.createDataFrame([("p", "S", board_page(f"<p>7:25 am Departed 7:31 am {note} end</p>"))], "page_id string, terminal string, html string")
    times = spark.createDataFrame([("S", "07:25")], "terminal string, depart_hhmm string")
    rows = pages.board_rows_from_pages(page, times)
    assert rows.first().status_text.endswith("vehicles end") and len(rows.first().status_text) > 5000
    odd = spark.createDataFrame([("q", "S", "<p>Departures</p>" + "z" * 9000)], "page_id string, terminal string, html string")
    assert len(pages.fetch_status(odd, rows).first().raw) > 9000
    log = spark.createDataFrame([("https://h/x?utm_term=" + "t" * 700, "Firefox/121.0")], "url string, agent string")
    assert len(classify_requests(log).first().utm_term) == 700


def test_an_index_that_is_no_list_is_named(spark):
    index = spark.createDataFrame([("S", "a", '{"x": 1}'), ("S", "b", '["junk"]'), ("S", "c", '["2026-07-01 00:00:00", "2026-07-01 00:00:00"]')], "terminal string, camera string, payload string")
    assert {r.camera: r.error for r in listings.index_errors(index, "yyyy-MM-dd HH:mm:ss").collect()} == {"a": "index is no list", "b": "index holds no readable time"}
    assert listings.index_moments(index, "yyyy-MM-dd HH:mm:ss").count() == 1


def test_a_closed_stream_gives_the_whole_answer(spark):
    rows = spark.createDataFrame([("S", "c", datetime(2026, 7, 10) + timedelta(minutes=7 * k)) for k in range(400)], "terminal string, camera string, captured_at timestamp")
    whole = rows.groupBy(F.date_trunc("hour", "captured_at").alias("hour"), "terminal", "camera").agg(F.count("*").alias("frames"))
    emitted = whole.filter("hour < '2026-07-11 20:00:00'")
    tail = feeds.held_back(rows, "captured_at", "2 hours").groupBy(F.date_trunc("hour", "captured_at").alias("hour"), "terminal", "camera").agg(F.count("*").alias("frames"))
    assert sorted(map(tuple, feeds.closed(emitted, tail, ["hour", "terminal", "camera"]).collect())) == sorted(map(tuple, whole.collect()))


def test_every_check_names_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))
