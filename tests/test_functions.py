"""Calendar, clock, claim and text scalars against literal cases and brute force."""

from __future__ import annotations

import itertools
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewait.functions import calendar as cal
from tidewait.functions import claims, clock, stats, wind


def easter(year: int) -> date:
    """First Sunday after the paschal full moon, by table lookup of the epact."""
    g, c = year % 19 + 1, year // 100 + 1
    x, z = 3 * c // 4 - 12, (8 * c + 5) // 25 - 5
    d, e = 5 * year // 4 - x - 10, (11 * g + 20 + z - x) % 30
    e += (e == 25 and g > 11) or e == 24
    n = 44 - e
    n += 30 * (n < 21)
    n += 7 - (d + n) % 7
    return date(year, 3, 1) + timedelta(days=n - 1)


def test_easter_and_good_friday_agree_with_another_method(spark):
    years = spark.range(1600, 2500).select(F.col("id").cast("int").alias("y"))
    found = dict(years.select("y", cal.easter_sunday(F.col("y"))).collect())
    assert all(found[y] == easter(y) for y in range(1600, 2500))
    days = spark.sql("select explode(sequence(date'1900-03-01', date'2299-04-30')) as d").filter("month(d) in (3,4)")
    fridays = {r[0] for r in days.filter(cal.is_good_friday(F.col("d"))).collect()}
    assert fridays == {easter(y) - timedelta(days=2) for y in range(1900, 2300)}


def test_holiday_test_and_name_agree(spark):
    days = spark.sql("select explode(sequence(date'1995-01-01', date'2035-12-31')) as d")
    named = days.select(cal.holiday_name(F.col("d")).isNotNull().alias("a"), cal.is_holiday(F.col("d")).alias("b"))
    assert named.filter("a <> b").count() == 0
    assert named.filter("a").count() == 41 * 11
    listed = cal.holidays_of_years(spark.range(1995, 2036).select(F.col("id").cast("int").alias("year")))
    back = listed.filter(F.col("name") != cal.holiday_name(F.col("day")))
    assert listed.count() == 41 * 11 and back.count() == 0


@pytest.mark.parametrize(
    ("day", "season", "long_weekend", "day_type"),
    [
        (date(2026, 9, 7), "peak_summer", True, "sunday_holiday"),  # Labour Day itself
        (date(2026, 9, 8), "shoulder", False, "weekday"),
        (date(2026, 6, 24), "shoulder", False, "weekday"),
        (date(2026, 6, 25), "peak_summer", False, "weekday"),
        (date(2026, 4, 4), "shoulder", False, "saturday"),  # Saturday after Good Friday
        (date(2026, 4, 5), "shoulder", True, "sunday_holiday"),  # Easter Sunday
        (date(2026, 4, 3), "shoulder", True, "sunday_holiday"),  # Good Friday
        (date(2026, 5, 16), "shoulder", True, "saturday"),  # before Victoria Day
        (date(2026, 5, 15), "shoulder", True, "friday"),
        (date(2026, 11, 1), "winter", False, "sunday_holiday"),
        (date(2028, 12, 30), "winter", True, "saturday"),  # New Year's Day on the Monday
    ],
)
def test_calendar_cases(spark, day, season, long_weekend, day_type):
    d = F.lit(day)
    got = spark.range(1).select(cal.season(d), cal.is_long_weekend(d), cal.day_type(d)).first()
    assert tuple(got) == (season, long_weekend, day_type)


def test_gap_and_overlap_take_the_first_reading(spark):
    at = lambda d, h: clock.combine_local(F.lit(d).cast("date"), F.lit(h), "America/Vancouver").cast("timestamp_ntz")
    gap, overlap = spark.range(1).select(at("2026-03-08", "02:30"), at("2026-11-01", "01:30")).first()
    assert gap == datetime(2026, 3, 8, 10, 30) and overlap == datetime(2026, 11, 1, 8, 30)


def test_minute_conventions(spark):
    a, b = F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit("2024-01-01 10:00:30").cast("timestamp")
    row = spark.range(1).select(
        clock.minutes_floor(a, b), clock.minutes_clamped(a, b), clock.minutes_clamped(a, F.lit(None).cast("timestamp"))
    ).first()
    assert tuple(row) == (-1, 0, None)


def test_outcome_from_axes_truth_table(spark):
    options = (None, True, False)
    cases = list(itertools.product(options, options, (True, False), (None, "waited_1", "waited_2plus")))
    df = spark.createDataFrame(cases, "f boolean, l boolean, c boolean, w string")
    got = df.select("f", "l", "c", "w", claims.outcome_from_axes(F.col("f"), F.col("l"), F.col("c"), F.col("w"))).collect()
    for f, left, c, w, out in got:
        want = (
            "cancelled" if c else w if w else "filled" if f
            else "boarded" if f is False or left is False else "unknown"
        )
        assert out == want


def test_merge_claims_over_every_combination(spark):
    cameras = ("boarded", "waited_1", "waited_2plus", "filled", "cancelled", "unknown")
    decks = ("boarded", "filled", "cancelled", "unknown")
    reports = (None, "boarded", "filled", "waited_1", "waited_2plus")
    cases = list(itertools.product(cameras, decks, (None, True, False), reports))
    df = spark.createDataFrame(cases, "camera string, deck string, note boolean, reported string")
    out = claims.merge_claims(
        F.col("camera"), F.col("camera") == "cancelled", F.col("deck"), F.col("note"), F.col("reported")
    )
    missed = {"filled", "waited_1", "waited_2plus"}
    for r in df.select("*", *[v.alias(k) for k, v in out.items()]).collect():
        fills = {r.camera, r.reported} & missed or r.note or r.deck == "filled"
        strands = {r.camera, r.reported} & missed
        lifts = "boarded" in (r.camera, r.reported)
        # A report proves the service ran; without one, either machine may call it off.
        assert r.cancelled == (r.reported is None and "cancelled" in (r.camera, r.deck)), r
        if r.cancelled:
            assert (r.filled, r.left_behind, r.waited) == (None, None, None), r
            continue
        # Nothing un-fills, and "had space" only ever fills a gap.
        assert r.filled is (True if fills else False if r.deck == "boarded" else None), r
        assert r.left_behind is (True if strands else False if lifts else None), r
        # The wait a report leaves open replaces the camera's.
        source = r.reported if r.reported in missed else r.camera
        assert r.waited == (source if source.startswith("waited") else None), r


@pytest.mark.parametrize(
    ("case", "want"),
    [
        (dict(r=None, d=80), "unknown"), (dict(r=80, d=None), "unknown"), (dict(r=2, d=80), "boarded"),
        (dict(r=80, d=80, seen=False, berth=True), "cancelled"), (dict(r=80, d=80, seen=False), "unknown"),
        (dict(r=126, d=80), "waited_2plus"), (dict(r=125, d=80), "waited_1"), (dict(r=80, d=80, still=True), "unknown"),
        (dict(r=4, d=80, seen=False), "boarded"),
    ],
)
def test_classify_counts(spark, case, want):
    v = {"seen": True, "still": False, "berth": False} | case
    lit = lambda x: F.lit(x) if x is not None else F.lit(None).cast("int")
    verdict = claims.classify_counts(lit(v["r"]), lit(v["d"]), F.lit(v["seen"]), F.lit(v["still"]), F.lit(v["berth"]), 125, 5)
    assert spark.range(1).select(verdict.outcome).first()[0] == want


def test_three_medians(spark):
    df = spark.createDataFrame([(1, v) for v in (5, 1, 4, 2)] + [(2, v) for v in (3, 9, 7)], "k int, v int")
    upper = dict(df.groupBy("k").agg(stats.upper_median("v").cast("int")).collect())
    assert upper == {1: 4, 2: 7}
    ranks = {r.k: (r.lo, r.mid, r.hi) for r in stats.nearest_ranks(df, ["k"], "v", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()}
    want = {}
    for k, vs in {1: [1, 2, 4, 5], 2: [3, 7, 9]}.items():
        want[k] = tuple(vs[round(f * (len(vs) - 1))] for f in (0.25, 0.5, 0.75))
    assert ranks == want


def test_rank_correlation_needs_three_and_a_slope(spark):
    df = spark.createDataFrame(
        [("up", i, i * i) for i in range(5)] + [("flat", i, 3) for i in range(5)] + [("short", 1, 1), ("short", 2, 2)],
        "k string, x int, y int",
    )
    got = {r.k: r.rho for r in stats.rank_correlation(df, ["k"], "x", "y").collect()}
    assert got["flat"] is None and got["short"] is None and got["up"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    ("text", "knots", "band", "brief"),
    [
        ("Wind northwest 15 to 20 knots diminishing to northwest 10 to 15", 20, "strong", "NW 15–20 kt"),
        ("Wind southeast 10 knots increasing to 15 to 20", 20, "strong", "SE 10 kt"),
        ("Wind light", 10, "light", "light"),
        ("Wind storm force", 48, "storm", "storm"),
        ("Wind variable", None, "unknown", None),
        ("Wind west 250 knots", None, "unknown", "W"),
        (None, None, "unknown", None),
    ],
)
def test_wind(spark, text, knots, band, brief):
    w = F.lit(text).cast("string")
    got = spark.range(1).select(wind.wind_speed(w), wind.wind_band(wind.wind_speed(w)), wind.wind_brief(w)).first()
    assert tuple(got) == (knots, band, brief)


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("Today", (date(2026, 8, 13), "day")), ("Tonight", (date(2026, 8, 13), "night")),
        ("This afternoon", (date(2026, 8, 13), "day")), ("Thursday", (date(2026, 8, 20), "day")),
        ("Friday night", (date(2026, 8, 14), "night")), ("Someday", (None, None)), ("", (None, None)),
    ],
)
def test_period_labels(spark, label, want):
    d, half = wind.period_date(F.lit(label), F.lit(date(2026, 8, 13)))
    assert tuple(spark.range(1).select(d, half).first()) == want
