"""Image headers, keyed writes and streams that are restarted."""

from __future__ import annotations

import struct
from datetime import date, datetime, timedelta

import pytest

from tidewait.params import Params
from tidewait.sources import frames, sinks
from tidewait.sources.tables import fresh_dir
from tidewait.streaming import feeds

P = Params(zone="UTC")


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def frame(marker: int, width: int, height: int) -> bytes:
    return segment(marker, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")


SCAN = segment(0xDA, b"\x00") + frame(0xC0, 9, 9)
FILES = [
    (b"\xff\xd8\xff\xe0\x00\x04ab" + frame(0xC0, 640, 480) + SCAN, (640, 480)),
    (b"\xff\xd8" + segment(0xE1, b"\xff\xc0" * 900) + b"\xff\xff\xff\x01" + segment(0xC4, b"x" * 30) + frame(0xC2, 65535, 1), (65535, 1)),
    (b"\xff\xd8" + b"".join(segment(0xE2, b"icc") for _ in range(300)) + frame(0xC1, 3, 4), (3, 4)),
    (b"\xff\xd8" + SCAN, None),
    (b"\xff\xd8\xff\xe0\xff", None),
    ((b"\xff\xd8" + frame(0xC0, 640, 480))[:9], None),
    (b"\xff\xd8\xff\xe0\x00\x01" + frame(0xC0, 1, 1), None),
    (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 240 | 3 << 14), (320, 240)),
    (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 16383 | 0x1FFF << 14 | 1 << 28), (16384, 8192)),
    (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + struct.pack("<I", 70000)[:3] + struct.pack("<I", 9)[:3], (70001, 10)),
    (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x00\x01\x2a" + struct.pack("<HH", 320, 240), None),
    (b"RIFF\0\0\0\0WEBPALPH", None),
    (b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + struct.pack(">II", 5, 6), (5, 6)),
    (b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR\0\0\0\x05\0", None),
    (b"GIF89a" + struct.pack("<HH", 300, 2), (300, 2)),
    (b"GIF89a\x01", None),
]


def test_every_type_states_its_size_or_gives_an_error_row(spark):
    rows = [("S", str(k), datetime(2026, 7, 1), bytearray(content), None, None) for k, (content, _) in enumerate(FILES)]
    fetched = spark.createDataFrame(rows, "terminal string, camera string, captured_at timestamp, content binary, content_type string, error string")
    got = {int(r.camera): r for r in frames.ingest_frames(fetched, P).collect()}
    for k, (_, want) in enumerate(FILES):
        assert got[k].status == "ok"
        assert (got[k].width, got[k].height) == (want or (None, None)), k
    assert {int(r.camera) for r in frames.size_errors(fetched).collect()} == {k for k, (_, want) in enumerate(FILES) if want is None}


def test_an_append_counts_its_own_rows_in_one_job(spark):
    path = fresh_dir(spark, "append")
    schema = "id int, k string, v int"
    batch = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (4, None, 8)], schema).coalesce(1)
    assert sinks.append_new(path, batch, ["k"], ["id"]) == 3
    more = spark.createDataFrame([(5, "b", 0), (6, "c", 1), (7, None, 8)], schema).coalesce(1)
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("append", "append")
    try:
        assert sinks.append_new(path, more, ["k"], ["id"]) == 2
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("append")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for n, v in before.items():
            spark.conf.set(n, v)
    # One job lists the schema-given table's files at most; the rows are written and counted by one.
    assert len(jobs) == 1
    assert sinks.append_new(path, more.filter("k is not null"), ["k"], ["id"]) == 0
    assert sorted((r.k or "", r.id) for r in spark.read.schema(schema).parquet(path).collect()) == [("", 4), ("", 7), ("a", 1), ("b", 3), ("c", 6)]


@pytest.mark.parametrize("update", [None, ["v"]])
def test_a_keyed_write_touches_only_its_dates_and_may_be_repeated(spark, update):
    path = fresh_dir(spark, "keyed")
    schema = "k string, service_date date, n int, v int, w int"
    d1, d2, d3 = (date(2026, 7, d) for d in (1, 2, 3))
    sinks.write_keyed(path, spark.createDataFrame([("a", d1, 1, 10, 100), ("b", d2, 1, 20, 200), ("c", d3, 1, 30, 300)], schema), ["k"], ["n"], update)
    untouched = lambda: {f for f in spark.read.parquet(path).inputFiles() if "service_date=2026-07-01" in f}
    files = untouched()
    batch = spark.createDataFrame([("b", d2, 2, 21, 201), ("b", d2, 3, None, 202), ("d", d3, 5, 41, 401), ("d", d3, 4, 40, 400)], schema)
    for _ in range(2):
        sinks.write_keyed(path, batch, ["k"], ["n"], update)
    got = {r.k: (r.n, r.v, r.w) for r in spark.read.schema(schema).parquet(path).collect()}
    if update:
        assert got == {"a": (1, 10, 100), "b": (1, None, 200), "c": (1, 30, 300), "d": (4, 41, 400)}
    else:
        assert got == {"a": (1, 10, 100), "b": (3, None, 202), "c": (1, 30, 300), "d": (5, 41, 401)}
    assert untouched() == files and len(files) == 1


POSITIONS = "row_id long, route string, vessel string, reported_at timestamp, status string, speed_knots double"


def test_departures_go_on_after_a_restart(spark):
    """A berth seen before the restart makes the edge after it; nothing is emitted twice."""
    folder, out = fresh_dir(spark, "in"), fresh_dir(spark, "out")
    base = datetime(2026, 7, 10, 5)
    words = ["Stopped", "Under Way", "Stopped", "Stopped", "Under Way", "Stopped", "Under Way", "Docking", "Stopped", "Under Way"]
    data = [(k, "r", "V", base + timedelta(minutes=10 * k), w, None) for k, w in enumerate(words)] + [(99, "r", "V", base + timedelta(days=4), "Stopped", None)]

    def run() -> None:
        stream = spark.readStream.schema(POSITIONS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        feeds.write_available(feeds.departure_detection(stream, "1 hour", P), f"{out}/rows", f"{out}/progress").awaitTermination()

    for n, part in enumerate((data[3:6] + data[0:3], data[6:9], data[9:])):
        spark.createDataFrame(part, POSITIONS).coalesce(1).write.parquet(f"{folder}/f{n}")
        run()
    got = [(r.moment - base).seconds // 600 for r in spark.read.parquet(f"{out}/rows").collect()]
    assert sorted(got) == [1, 4, 6, 9]


def test_a_verdict_is_given_once_when_its_day_is_over(spark):
    folder, out = fresh_dir(spark, "in"), fresh_dir(spark, "out")
    day = datetime(2026, 7, 10)
    schema = "row_id long, route string, terminal string, observed_at timestamp, service_date date, hhmm string, percent_available int, status_text string, departed_hhmm string, fetch_status string"

    def row(k: int, minute: int, hhmm: str, text: str, gone: str | None = None, days: int = 0) -> tuple:
        return (k, "r", "S", day + timedelta(days=days, minutes=minute), (day + timedelta(days=days)).date(), hhmm, None, text, gone, "ok")

    batches = [
        [row(1, 480, "08:00", "Departed", "08:01"), row(2, 500, "08:00", "Departed", "08:01"), row(3, 500, "09:00", "Upcoming")],
        [row(4, 560, "09:00", "Departed", "09:02"), row(5, 580, "09:00", "Departed", "09:02")],
        [row(6, 1300, "09:00", "Loading maximum number of vehicles"), row(7, 60, "01:00", "Upcoming", None, 3)],
    ]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/f{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    feeds.write_available(feeds.note_wait(stream, "2 hours", P), f"{out}/rows", f"{out}/progress").awaitTermination()
    got = sorted((r.hhmm, r.outcome) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [("08:00", "boarded"), ("09:00", "unknown")]
    whole = feeds.note_wait_rest(spark.createDataFrame(sum(batches, []), schema), P)
    assert {(r.hhmm, r.outcome) for r in whole.collect()} == {*got, ("01:00", "unknown")}


def test_far_dates_are_read_apart():
    d = [date(2026, 7, k) for k in (3, 1, 2, 9, 3)] + [date(2024, 1, 1)]
    assert feeds.date_runs(d) == [(date(2024, 1, 1),) * 2, (date(2026, 7, 1), date(2026, 7, 3)), (date(2026, 7, 9),) * 2]
    assert feeds.date_runs([]) == []
