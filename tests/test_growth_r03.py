"""Work that must not grow faster than the input: what a plan repeats, and results on crowded days."""

from __future__ import annotations

import statistics
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewait.functions import stats
from tidewait.operators import ledger
from tidewait.operators.reports import validate_reports
from tidewait.params import Params
from tidewait.sources import forecast_xml

P = Params(zone="UTC")
DAY = datetime(2024, 1, 5)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _services(spark, clocks):
    rows = [("r1", "A", DAY.date(), c, datetime.combine(DAY, datetime.strptime(c, "%H:%M").time())) for c in clocks]
    return spark.createDataFrame(rows, "route string, origin string, service_date date, depart_hhmm string, scheduled timestamp")


def test_the_hand_out_looks_for_a_departure_once_a_slot(spark):
    clocks = ["07:25", "07:40", "08:20", "08:20", "12:00"]
    services = _services(spark, [*clocks[:3], clocks[4]]).unionByName(_services(spark, ["08:20"]).withColumn("depart_hhmm", F.lit("08:21")))
    moments = [DAY + timedelta(hours=6, minutes=50, seconds=37 * k) for k in range(0, 400, 3)] + [DAY + timedelta(hours=13, minutes=10)]
    left = spark.createDataFrame([("r1", "A", DAY.date(), m) for m in moments], "route string, origin string, service_date date, left_at timestamp")
    paired = ledger.pair_departures(services, left, P)
    # Brute force: the earliest unused departure in reach, slots in order of time.
    free, want = sorted(moments), {}
    for s in sorted(services.collect(), key=lambda r: (r.scheduled, r.depart_hhmm)):
        reach = [m for m in free if s.scheduled - timedelta(minutes=P.grace_minutes) <= m <= s.scheduled + timedelta(minutes=P.late_tolerance_minutes)]
        if reach:
            want[s.depart_hhmm] = reach[0]
            free.remove(reach[0])
    assert {r.depart_hhmm: r.tracked_at for r in paired.collect()} == want and len(want) == 5
    # A filter inside another one's lambda is run for every departure: a day costs the square of its departures.
    steps = [line for line in _plan(paired).splitlines() if "aggregate(" in line]
    assert len(steps) == 1 and steps[0].count("filter(") <= 2, [s.count("filter(") for s in steps]


def test_no_frame_of_the_ledger_reaches_to_the_end_of_a_day(spark):
    rows = [("r1", date(2024, 1, 5), ["A", "B"], DAY + timedelta(minutes=40 * k), k, k + 1, {1: "B", 4: "B", 9: "A"}.get(k)) for k in range(12)]
    anchored = spark.createDataFrame(
        rows, "route string, ledger_date date, ends array<string>, moment timestamp, row_id long, position int, anchor string"
    )
    cut = ledger.ledger_segments(anchored, P)
    # Anchors at 2 and 5 disagree (odd distance, same end); those at 5 and 10 agree.
    assert [r.segment for r in cut.orderBy("position").collect()] == [0, 0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2]
    assert "unboundedfollowing" not in _plan(cut)


def test_reports_are_looked_up_by_service_and_not_by_terminal(spark):
    services = _services(spark, ["07:25", "09:25"])
    ends = spark.createDataFrame([("r1", "A")], "route string, terminal string")
    board = spark.createDataFrame([("r1", "A", DAY.date(), "07:25", datetime(2024, 1, 5, 7, 40))], "route string, terminal string, service_date date, hhmm string, departed_at timestamp")
    sent = spark.createDataFrame(
        [(1, "r1", "A", DAY.date(), "07:25"), (2, "r1", "A", DAY.date(), "07:25"), (3, "r1", "Z", DAY.date(), "07:25"),
         (4, "r1", "A", DAY.date(), "03:33"), (5, None, "A", DAY.date(), "07:25"), (6, "r1", "A", None, "09:25")],
        "report_id long, route string, origin string, service_date date, depart_hhmm string",
    ).withColumns({
        "boarded": F.lit(True), "sailings_waited": F.lit(None).cast("int"), "joined_at": F.lit(datetime(2024, 1, 5, 7, 0)),
        "departed_at": F.lit(None).cast("timestamp"), "deck_fullness": F.lit("full"), "source": F.lit("web"),
        "submitted_at": F.lit(datetime(2024, 1, 5, 9, 0)),
    })
    done = validate_reports(sent, services, ends, board, P)
    assert {r.report_id: r.reason for r in done.collect()} == {
        1: None, 2: None, 3: "unknown terminal", 4: "not in timetable", 5: "unknown terminal", 6: "not in timetable",
    }
    # What meets on a terminal alone has been made distinct first.
    lines = _plan(done).splitlines()
    joins = [k for k, line in enumerate(lines) if "Join" in line and "origin" in line and "depart_hhmm" not in line]
    assert joins and all("Aggregate" in lines[k + 1] for k in joins), [lines[k + 1] for k in joins]


def test_ranks_keep_no_key_of_a_task_in_a_table(spark):
    rows = [("a", x, y) for x, y in ((1, 5), (2, 5), (2, 7), (2, 7), (4, 1))] + [("b", 1, 1), ("b", None, 2), (None, 1, 2), (None, 2, 4), (None, 3, 3)]
    rho = stats.rank_correlation(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], "x", "y")
    got = {r.k: (r.n, r.rho if r.rho is None else round(r.rho, 9)) for r in rho.collect()}

    def rank(v, values):
        return sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2

    def brute(pairs):
        rx = [rank(x, [p[0] for p in pairs]) for x, _ in pairs]
        ry = [rank(y, [p[1] for p in pairs]) for _, y in pairs]
        return round(statistics.correlation(rx, ry), 9)

    assert got == {"a": (5, brute([r[1:] for r in rows[:5]])), "b": (1, None), None: (3, brute([r[1:] for r in rows[7:]]))}
    # One grouping, that of equal pairs, which is shared out by the whole pair.
    assert _plan(rho).count("Aggregate [") == 1


def test_a_warning_is_read_once_a_document(spark):
    xml = """<marineData><area> Outer  Strait </area><warnings name="W &amp; G"><event type='t' priority="urgent">in  effect</event><a/> tail</warnings>
<regularForecast><dateTime zone="UTC"><timeStamp>202401050930</timeStamp></dateTime><location name="south"><weatherCondition><wind>Wind  west 10 to 15 knots</wind><periodOfCoverage> </periodOfCoverage></weatherCondition></location></regularForecast>
<extendedForecast><location><weatherCondition><forecastPeriod name="Sunday">Wind light</forecastPeriod><forecastPeriod name="Someday">x</forecastPeriod></weatherCondition></location></extendedForecast></marineData>"""
    docs = spark.createDataFrame([(1, xml, "south"), (2, "<marineData><warnings>", None), (3, None, None)], "doc_id long, xml string, preferred string")
    rows = forecast_xml.marine_forecast_rows(docs, P)
    got = [(r.doc_id, r.service_date, r.kind, r.period, r.wind, r.wind_max_kt, r.warning, r.area) for r in rows.filter("error is null").collect()]
    said = "W & G · t · urgent · in effect"
    assert got == [
        (1, date(2024, 1, 5), "regular", None, "Wind west 10 to 15 knots", 15, said, "Outer Strait"),
        (1, date(2024, 1, 6), "regular", None, "Wind west 10 to 15 knots", 15, said, "Outer Strait"),
        (1, date(2024, 1, 7), "extended", "Sunday", "Wind light", 10, said, "Outer Strait"),
    ]
    lines = _plan(rows).splitlines()
    generate = next(k for k, line in enumerate(lines) if "Generate explode" in line)
    assert not any("<warnings" in line for line in lines[:generate])


def test_a_half_day_reads_its_label_once(spark):
    xml = """<siteData><location><name>Some  Town</name></location><forecastGroup><dateTime zone="UTC"><timeStamp>20240105180000</timeStamp></dateTime><dateTime zone="PST"><timeStamp>20240105100000</timeStamp></dateTime>
<forecast><period textForecastName="Sunday night">x</period><textSummary>Rain.</textSummary><abbreviatedForecast><textSummary> </textSummary><pop units="%">40</pop></abbreviatedForecast><temperatures><temperature class="low">3</temperature></temperatures></forecast>
<forecast><period> this  evening </period></forecast></forecastGroup></siteData>"""
    rows = forecast_xml.shore_forecast_rows(spark.createDataFrame([(1, xml)], "doc_id long, xml string"))
    got = [(r.service_date, r.kind, r.period, r.condition, r.pop, r.temp_high, r.temp_low, r.summary) for r in rows.collect()]
    assert got == [
        (date(2024, 1, 7), "night", "Sunday night", None, 40, None, 3, "Rain."),
        (date(2024, 1, 5), "day", "this evening", None, None, None, None, None),
    ]
    assert _plan(rows).count("_VALUE, \\s+") <= 3
