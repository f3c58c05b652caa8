"""Operators on small literal tables, against named cases and brute force."""

from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewait.operators import board as brd
from tidewait.functions.clock import hhmm_minutes
from tidewait.operators import cohort, intervals, ledger, pixels, quality, reports, retention, services, spend
from tidewait.operators.reports import report_bounds, report_entries
from tidewait.params import Params

P = Params(zone="UTC")
DAY = date(2026, 7, 10)


def at(text: str, day: date = DAY) -> datetime:
    return datetime.fromisoformat(f"{day} {text}")


@pytest.fixture
def terminals(spark):
    return spark.createDataFrame([("r", "S", "E"), ("r", "E", "S")], "route string, terminal string, destination string")


def positions(spark, *readings, vessel="V"):
    data = [("r", vessel if isinstance(vessel, str) else vessel(i), at(t), s, None, i) for i, (t, s) in enumerate(readings)]
    return spark.createDataFrame(
        data, "route string, vessel string, reported_at timestamp, status string, speed_knots double, row_id int"
    )


def board(spark, *rows):
    data = [
        (i, "r", terminal, at(seen), DAY, hhmm, departed, percent, text, "ok")
        for i, (terminal, seen, hhmm, departed, percent, text) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "row_id int, route string, terminal string, observed_at timestamp, service_date date, hhmm string, "
        "departed_hhmm string, percent_available int, status_text string, fetch_status string",
    )


def shuttle(*moments):
    """Stopped, then moving at each moment; a silent reading between changes nothing."""
    out = []
    for m in moments:
        before = (at(m) - timedelta(minutes=4)).strftime("%H:%M")
        silent = (at(m) - timedelta(minutes=2)).strftime("%H:%M")
        out += [(before, "Stopped"), (silent, "???"), (m, "Under Way")]
    return out


def labels(spark, terminals, moments, published, **kw):
    pos = positions(spark, *shuttle(*moments), **kw)
    got = ledger.departure_ledger(pos, board(spark, *published), terminals, P)
    return [(r.moment.strftime("%H:%M"), r.terminal) for r in got.orderBy("moment").collect()]


def test_one_anchor_names_the_whole_day(spark, terminals):
    got = labels(spark, terminals, ["05:40", "06:40", "07:40", "08:40"], [("S", "07:00", "05:35", "05:38", None, "x")])
    assert got == [("05:40", "S"), ("06:40", "E"), ("07:40", "S"), ("08:40", "E")]


def test_without_an_anchor_nothing_is_named(spark, terminals):
    assert {t for _, t in labels(spark, terminals, ["05:40", "06:40"], [("S", "12:00", "11:00", "11:05", None, "x")])} == {None}


def test_anchors_that_disagree_cut_the_stretch_between(spark, terminals):
    published = [("S", "06:00", "05:35", "05:40", None, "x"), ("S", "09:00", "08:35", "08:40", None, "x")]
    got = labels(spark, terminals, ["05:40", "06:40", "07:40", "08:40"], published)
    assert got == [("05:40", "S"), ("06:40", None), ("07:40", None), ("08:40", "S")]


def test_a_step_too_short_cuts_the_chain(spark, terminals):
    got = labels(spark, terminals, ["05:40", "06:00", "07:00"], [("S", "06:00", "05:35", "05:40", None, "x")])
    # The second step lies within the matching distance of no published departure.
    assert got[0] == ("05:40", "S") and got[1][1] is None and got[2][1] is None


def test_two_vessels_or_three_ends_say_nothing(spark, terminals):
    published = [("S", "06:00", "05:35", "05:40", None, "x")]
    assert labels(spark, terminals, ["05:40", "06:40"], published, vessel=lambda i: f"V{i % 2}") == []
    third = terminals.union(spark.createDataFrame([("r", "X", "S")], terminals.schema))
    assert labels(spark, third, ["05:40", "06:40"], published) == []


def test_pairing_is_ordered_and_exclusive(spark):
    def timetable(*times):
        return spark.createDataFrame(
            [("r", "S", DAY, t, at(t)) for t in times],
            "route string, origin string, service_date date, depart_hhmm string, scheduled timestamp",
        )

    left = spark.createDataFrame(
        [("r", "S", DAY, at(t)) for t in ("08:30", "08:50")],
        "route string, origin string, service_date date, left_at timestamp",
    )
    got = ledger.pair_departures(timetable("07:25", "08:20", "12:00"), left, P).collect()
    assert {r.depart_hhmm: r.tracked_at for r in got} == {"07:25": at("08:30"), "08:20": at("08:50")}


def test_midnight_departure_stays_with_its_date(spark):
    rows = board(spark, ("S", "23:55", "23:50", "00:05", None, "Departed 12:05 am"))
    assert brd.board_departures(rows, P).first().departed_at == datetime(2026, 7, 11, 0, 5)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("07:00", None, "Upcoming"), ("07:30", "07:28", "Departed 7:28 am"), ("07:50", None, "Upcoming")], "boarded"),
        ([("07:30", "07:28", "Departed 7:28 am"), ("07:40", None, "x")], "unknown"),
        ([("07:30", "07:28", "Departed"), ("07:50", None, "Loading MAXIMUM number of vehicles")], "unknown"),
        ([("07:00", None, "Upcoming"), ("08:00", None, "Upcoming")], "unknown"),
        ([("07:00", None, "Cancelled")], "cancelled"),
    ],
)
def test_silence_of_a_board_without_percentages(spark, rows, want):
    made = board(spark, *[("S", seen, "07:25", dep, None, text) for seen, dep, text in rows])
    assert brd.board_summary(made, P).first().deck_outcome == want


@pytest.mark.parametrize(
    ("percents", "want"),
    [
        ([("07:00", 40), ("07:20", 0)], ("filled", 0.7)), ([("07:10", 40)], ("boarded", 0.65)),
        ([("06:50", 40)], ("boarded", 0.5)), ([("06:30", 40)], ("unknown", None)), ([("07:40", 0)], ("unknown", None)),
    ],
)
def test_board_percentages(spark, percents, want):
    made = board(spark, *[("S", seen, "07:25", None, p, "x") for seen, p in percents])
    got = brd.board_summary(made, P).first()
    assert (got.deck_outcome, got.deck_confidence) == want


def test_interval_join_meets_every_pair_once_even_when_one_hour_is_crowded(spark):
    rng = random.Random(3)
    base = at("00:00")
    times = [base + timedelta(seconds=36000 + i % 600) for i in range(600)] + [
        base + timedelta(seconds=rng.randrange(86400)) for _ in range(600)
    ]
    points = [(i, "S", t) for i, t in enumerate(times)]
    spans = [(j, "S", s, s + timedelta(minutes=rng.randrange(1, 200))) for j, s in enumerate(
        base + timedelta(minutes=rng.randrange(1400)) for _ in range(40))]
    got = intervals.interval_join(
        spark.createDataFrame(points, "p int, terminal string, t timestamp"),
        spark.createDataFrame(spans, "s int, terminal string, a timestamp, z timestamp"),
        ["terminal"], "t", "a", "z", salts=4,
    ).select("p", "s").collect()
    want = {(p, s) for p, _, t in points for s, _, a, z in spans if a <= t <= z}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_steps_cross_the_hour_but_not_a_long_gap(spark):
    times = ["09:50", "10:05", "10:40", "10:41", "12:00"]
    df = spark.createDataFrame(
        [("S", at(t), i, 10 * i * i) for i, t in enumerate(times)],
        "terminal string, captured_at timestamp, frame_id int, vehicle_count int",
    )
    got = sorted((r.frame_id, r.step) for r in quality.reading_steps(df, ["terminal"]).collect())
    assert got == [(1, 10), (3, 50)]


def history(spark, n=900, seed=5):
    """Records with a third of all rows in one slot, and dates that repeat within a slot."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(40 if hot else 500))
        hhmm = "08:30" if hot else rng.choice(["08:20", "08:30", "09:20", "16:00"])
        outcome = rng.choice(["boarded", "filled", "waited_1", "cancelled", "unknown"])
        out.append((i, "r", "S", day, hhmm, datetime.fromisoformat(f"{day} {hhmm}"), outcome))
    df = spark.createDataFrame(
        out, "service_id int, route string, origin string, service_date date, depart_hhmm string, scheduled timestamp, outcome string"
    )
    nothing = F.lit(None)
    from tidewait.functions.calendar import with_calendar

    return with_calendar(df).select(
        "*", nothing.cast("boolean").alias("filled"), nothing.cast("boolean").alias("left_behind"),
        nothing.cast("boolean").alias("left_full"), nothing.cast("timestamp").alias("filled_at"), F.lit("report").alias("method"),
    )


def test_widening_search_against_brute_force_with_a_hot_slot(spark):
    records = history(spark)
    p = Params(zone="UTC", min_sample=4, max_samples=4)
    got = {
        (r.service_date, r.depart_hhmm): (r.rung, [m.service_id for m in r.matches])
        for r in cohort.per_target(cohort.walk_rungs(records, records, p)).collect()
    }
    table = [r.asDict() for r in records.collect()]
    partner = {"weekday": "friday", "friday": "weekday", "saturday": "sunday_holiday", "sunday_holiday": "saturday"}
    minute = lambda h: int(h[:2]) * 60 + int(h[3:])
    assert len(got) == len({(r["service_date"], r["depart_hhmm"]) for r in table})
    for t in table:
        pool = sorted(
            (c for c in table if c["outcome"] != "unknown" and c["service_date"] != t["service_date"]),
            key=lambda c: (c["service_date"], c["scheduled"], c["service_id"]), reverse=True,
        )
        gap = lambda c: abs(minute(c["depart_hhmm"]) - minute(t["depart_hhmm"]))
        same = lambda c, k: c[k] == t[k]
        tests = [
            lambda c: same(c, "day_type") and gap(c) <= 15 and same(c, "long_weekend") and same(c, "season"),
            lambda c: same(c, "day_type") and gap(c) <= 15 and same(c, "long_weekend"),
            lambda c: same(c, "day_type") and gap(c) <= 60 and same(c, "long_weekend"),
            lambda c: same(c, "day_type") and gap(c) <= 60,
            lambda c: c["day_type"] in (t["day_type"], partner[t["day_type"]]) and gap(c) <= 60,
        ]
        for rung, test in enumerate(tests, 1):
            found = [c["service_id"] for c in pool if test(c)][:4]
            if len(found) >= 4:
                break
        assert got[t["service_date"], t["depart_hhmm"]] == (rung, found)


def test_axis_counts_add_up(spark):
    got = cohort.distribution(history(spark), history(spark), P)
    assert got.filter("had_space + filled_count + cancelled_count <> n").count() == 0
    assert got.filter("left_behind_count + took_everyone + unresolved <> filled_count").count() == 0


def test_report_bounds_leave_out_the_targets_own_date(spark):
    days = [date(2026, 7, d) for d in (6, 7, 8)]  # plain weekdays
    reports = spark.createDataFrame(
        [("r", "S", d, "08:30", at("08:30", d) - timedelta(minutes=lead), ok) for d, lead, ok in
         [(days[0], 70, False), (days[1], 40, False), (days[1], 10, True), (days[2], 25, True), (days[2], -5, False)]],
        "route string, origin string, service_date date, depart_hhmm string, joined_at timestamp, boarded boolean",
    )
    targets = spark.createDataFrame(
        [("r", "S", d, "08:30", 50) for d in days],
        "route string, origin string, service_date date, depart_hhmm string, fill_minutes_before int",
    )
    got = {r.service_date: r for r in report_bounds(targets, reports, P).collect()}
    # The first day's own 70 is left out and the other failure is no earlier than the fill line.
    first = got[days[0]]
    assert first.turned_away_minutes_before is None and first.boarded_by_minutes_before == 10
    assert got[days[2]].turned_away_minutes_before == 70 and got[days[2]].boarded_by is None
    assert days[1] in got and got[days[1]].turned_away_date == days[0]


def test_report_entries_read_as_local_clocks(spark):
    df = spark.createDataFrame(
        [(1, "r", "S", DAY, "08:30", at("07:40"), at("08:51"), True, None, "half", "web", at("09:00"))],
        "report_id int, route string, origin string, service_date date, depart_hhmm string, joined_at timestamp, "
        "departed_at timestamp, boarded boolean, sailings_waited int, deck_fullness string, source string, submitted_at timestamp",
    )
    got = report_entries(df, P).first()
    assert (got.joined, got.departed, got.minutes_late, got.fullness, got.submitted) == ("07:40", "08:51", 21, "half", "09:00")


def test_budget_stops_after_the_row_that_reaches_it(spark):
    rows = [("m", 1 + i // 4, i, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "month string, day int, id int, cost_micros bigint")
    kept = spend.within_budget(df, ["month", "day"], [F.col("id")], Params(monthly_budget_usd=16e-6))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_nearest_frame_tie_goes_to_the_earlier_and_one_frame_may_serve_twice(spark):
    timetable = spark.createDataFrame(
        [("r", "S", DAY, "08:30", at("08:30"))],
        "route string, origin string, service_date date, depart_hhmm string, scheduled timestamp",
    )
    frames = spark.createDataFrame(
        [(1, "S", "main", at("08:10"), "ok", "p"), (2, "S", "main", at("08:05"), "ok", "p"), (3, "S", "main", at("07:55"), "ok", "p")],
        "frame_id int, terminal string, camera string, captured_at timestamp, status string, path string",
    )
    got = {r.offset: r.frame_id for r in intervals.nearest_frames(timetable, frames, P).collect()}
    assert got == {-30: 3, -10: 1}


def test_retention_keeps_a_camera_hour_apart(spark):
    old = datetime(2026, 1, 5, 10)
    frames = spark.createDataFrame(
        [(i, "S", c, old + timedelta(minutes=m), "ok", "p") for i, (c, m) in enumerate([("main", 0), ("main", 5), ("road", 1), ("road", 59)])],
        "frame_id int, terminal string, camera string, captured_at timestamp, status string, path string",
    )
    read = frames.select("frame_id", F.lit("model").alias("version")).filter("frame_id <> 3")
    now = F.lit("2026-07-10").cast("timestamp")
    assert [r.frame_id for r in retention.hourly_surplus(frames, read, now, P).collect()] == [1]
    assert [r.frame_id for r in retention.held_back_frames(frames, read, now, P).collect()] == [3]


def test_first_block_wins_and_unknown_terminals_are_dropped(spark, terminals):
    blocks = spark.createDataFrame(
        [(1, "S", None, DAY, DAY, [4], ["08:30", "12:30"]), (2, "S", None, DAY, DAY, [4], ["12:30", "23:50"]),
         (3, "Q", None, DAY, DAY, [4], ["09:00"]), (4, "S", "other", DAY, DAY, [4], ["10:00"]), (5, "S", None, DAY, DAY, [5], ["11:00"])],
        "block_no int, terminal string, route string, effective_from date, effective_to date, days array<int>, departures array<string>",
    )
    days = spark.createDataFrame([(DAY,)], "service_date date")
    got = services.expand_timetable(days, blocks, terminals, P).orderBy("depart_hhmm").collect()
    assert [(r.depart_hhmm, r.block_no) for r in got] == [("08:30", 1), ("12:30", 1), ("23:50", 2)]


def test_clocks_that_are_none_are_null(spark):
    texts = ["05:35", "5:35", "5h35", "25:00", "12:60", "abc", "", None, "12"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hhmm_minutes(F.col("t"))).collect()
    assert [r[0] for r in got] == [335, 335, None, None, None, None, None, None, None]


def test_a_budget_of_nothing_is_no_budget_and_prices_keep_their_cents(spark):
    reads = spark.createDataFrame([(1, 10, 5_000_000), (1, 11, 5_000_000), (1, 12, 5_000_000)], "m int, k int, cost_micros long")
    kept = lambda usd: spend.within_budget(reads, ["m", "k"], [F.col("k")], Params(monthly_budget_usd=usd)).count()
    assert (kept(0.0), kept(5.0), kept(6.0)) == (3, 1, 2)
    cheap = Params(usd_per_m_input=0.8, usd_per_m_output=0.25)
    cost = reads.select(spend.cost_micros(F.lit(1000), F.lit(10), cheap)).first()[0]
    assert cost == 803  # 800 and 2.5, halves up


def test_stored_reports_use_up_places(spark):
    base = datetime(2026, 7, 10, 20)
    sent = spark.createDataFrame(
        [(k, "r", "S", base.date(), "08:30" if k else "8h30", None, None, True, None, None, "web", base + timedelta(minutes=k)) for k in range(6)],
        "report_id long, route string, origin string, service_date date, depart_hhmm string, joined_at timestamp, departed_at timestamp, "
        "boarded boolean, sailings_waited int, deck_fullness string, source string, submitted_at timestamp",
    )
    services = sent.filter("report_id = 1").select("route", "origin", "service_date", "depart_hhmm")
    ends = spark.createDataFrame([("r", "S")], "route string, terminal string")
    board = spark.createDataFrame([], "route string, terminal string, service_date date, hhmm string, departed_at timestamp")
    few = Params(zone="UTC", max_reports_per_service=4)
    stored = sent.filter("report_id in (4, 5)")
    got = {r.report_id: r.reason for r in reports.validate_reports(sent, services, ends, board, few, stored).collect()}
    assert got == {0: "not in timetable", 1: None, 2: None, 3: "service is full", 4: "service is full", 5: "service is full"}


def test_a_frame_of_another_size_is_refused_alone(spark):
    still = [(k, "S", "c", datetime(2026, 7, 1, 10, 0, k), [100 + k % 3] * 64) for k in range(45)]
    odd = [(90, "S", "c", datetime(2026, 7, 1, 10, 1), [100] * 60), (91, "S", "c", datetime(2026, 7, 1, 10, 1), [101] * 64), (92, "S", "d", datetime(2026, 7, 1, 10, 1), [101] * 64)]
    frames = spark.createDataFrame(still + odd, "frame_id long, terminal string, camera string, captured_at timestamp, pixels array<int>")
    here = Params(zone="UTC")
    back = pixels.hourly_background(pixels.background_sample(frames, F.lit(datetime(2026, 7, 2)), here), frames)
    assert back.first().background == [101] * 64 and back.count() == 1
    lanes = F.array(F.struct(F.lit(1).alias("lane"), F.sequence(F.lit(0), F.lit(63)).alias("positions")))
    camera = spark.range(1).select(F.lit("S").alias("terminal"), F.lit("c").alias("camera"))
    cal = camera.select("*", lanes.alias("lanes"), F.lit(True).alias("covers_compound"), F.lit(False).alias("lanes_before_capacity"))
    pending = frames.filter("frame_id >= 90").withColumn("drift", F.lit(0.0))
    got = {r.frame_id: (r.usable, r.notes) for r in pixels.read_lane_frames(pending, back, cal, here).collect()}
    assert got == {90: (False, pixels.OTHER_SIZE), 91: (True, None)}
    assert [r.frame_id for r in pixels.read_lane_frames(pending, back, cal, here, max_reads=1).collect()] == [90]
    assert [tuple(r) for r in pixels.skipped_frames(pending, back, cal, here).collect()] == [(92, "no calibration")]
    lines = F.array(*[F.struct(F.lit(y).alias("row"), F.array(F.lit(3.4)).alias("xs")) for y in range(8)])
    geometry = camera.select("*", F.lit(8).alias("width"), F.lit(8).alias("height"), lines.alias("boundaries"))
    drift = {r.frame_id: r.drift for r in pixels.calibration_drift(pending.drop("drift"), geometry, 2).collect()}
    assert drift == {90: None, 91: float("inf"), 92: None}


def test_a_global_median_is_exact(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 400):
        values = [round(rng.choice([rng.uniform(-1, 1), 0.5, -1.0, 1.0]), 9) for _ in range(n)]
        got = quality.exact_median(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", -1.0, 1.0, cells=50).first()[0]
        assert got == pytest.approx(statistics.median(values), abs=1e-12)
    assert quality.exact_median(spark.createDataFrame([(None,)], "v double"), "v", -1.0, 1.0).first()[0] is None


def test_a_range_of_dates_gives_those_records_of_the_whole(spark):
    from checks.bound import Bound
    from checks.q_evidence import _evidence
    from tidewait.plans.service_record import service_records

    b = Bound(spark, "/root/testdata/sf0.001")
    first, last = date(2024, 1, 10), date(2024, 1, 12)
    asked = F.col("service_date").between(F.lit(first), F.lit(last))
    whole = service_records(b.services, _evidence(b), b.params).filter(asked).collect()
    part = service_records(b.services, _evidence(b), b.params, (first, last)).collect()
    assert whole and sorted(map(repr, part)) == sorted(map(repr, whole))


def test_both_limits_admit_in_order(spark):
    """A day's cap comes first; what it refuses costs the month nothing."""
    rng = np.random.default_rng(8)
    rows = [(1 + i // 400, i // 100, i, int(rng.integers(1, 9))) for i in range(800)] + [(1, 0, 10_000 + i, 3) for i in range(500)]
    reads = spark.createDataFrame(rows, "month int, day int, id int, cost_micros long").repartition(5)
    for cap, budget in ((7, 1e-3), (40, 4e-4), (None, 3e-4), (0, 1.0), (30, 0.0)):
        limits = Params(daily_frame_cap=cap, monthly_budget_usd=budget)
        got = {r.id for r in spend.admitted(reads, ["month", "day"], [F.col("id")], limits).collect()}
        want, spent, used = set(), {}, {}
        for month, day, i, cost in sorted(rows):
            if (cap is not None and used.get(day, 0) >= cap) or (budget and spent.get(month, 0) >= round(budget * 1e6)):
                continue
            want.add(i)
            used[day], spent[month] = used.get(day, 0) + 1, spent.get(month, 0) + cost
        assert got == want, (cap, budget)
