"""Instants, wall clocks and the three minute conventions.

Instants are TimestampType in a UTC session; wall-clock reasoning happens in a named zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_minutes(ts: Column, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds as a decimal-free double, microseconds kept."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def minutes_floor(later: Column, earlier: Column) -> Column:
    """Whole minutes rounded down: leads and lateness."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000)).cast("int")


def minutes_clamped(later: Column, earlier: Column) -> Column:
    """Whole minutes cut toward zero and never negative: fill gaps."""
    gap = minutes_floor(later, earlier)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0)))


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(seconds_between(a, b))


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(local_time(ts, zone))


def local_hhmm(ts: Column, zone: str) -> Column:
    return F.date_format(local_time(ts, zone), "HH:mm")


# A clock of a day, seconds or more behind it ignored.
DAY_CLOCK = r"^\s*(?:[01]?\d|2[0-3])\s*:\s*[0-5]?\d\s*(?::.*)?$"


def hhmm_minutes(hhmm: Column) -> Column:
    """Minutes after midnight of an HH:MM text; NULL for text that is no clock of a day."""
    hour = F.substring_index(hhmm, ":", 1)
    minute = F.substring_index(F.substring_index(hhmm, ":", 2), ":", -1)
    return F.when(hhmm.rlike(DAY_CLOCK), hour.cast("int") * 60 + minute.cast("int"))


def minutes_hhmm(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(1440))
    text = F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))
    return F.when(minutes.isNotNull(), text)


def combine_local(day: Column, hhmm: Column, zone: str) -> Column:
    """A wall clock on a local date as an instant; a gap or overlap takes the first reading."""
    return F.to_utc_timestamp(add_minutes(day.cast("timestamp"), hhmm_minutes(hhmm)), zone)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Stored text back to an instant; text without a zone is UTC; bad text is NULL."""
    return F.try_to_timestamp(F.trim(text))


def clock_to_24h(hour: Column, minute: Column, meridiem: Column) -> Column:
    """12 h or 24 h clock parts to HH:MM, NULL when out of range."""
    mark = F.lower(F.regexp_replace(F.coalesce(meridiem, F.lit("")), r"\.", ""))
    h, m = hour.cast("int"), minute.cast("int")
    h24 = (
        F.when(mark == "", F.when(h.between(0, 23), h))
        .when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(mark == "pm", 12).otherwise(0))
    )
    return F.when(
        m.between(0, 59) & h24.isNotNull(), F.format_string("%02d:%02d", h24, m)
    )


CLOCK_PATTERN = r"(?i)\b(\d{1,2}):(\d{2})\s*(am|pm|a\.m\.|p\.m\.)?"


def first_clock(text: Column) -> Column:
    """The first clock time written in a text, as HH:MM."""
    part = lambda i: F.regexp_extract(text, CLOCK_PATTERN, i)
    return F.when(
        F.length(part(1)) > 0, clock_to_24h(part(1), part(2), part(3))
    )


def dateless_stamp(observed_at: Column, hhmm: Column, zone: str) -> Column:
    """A feed clock without a date: the day of observation, or the day before when the
    clock would otherwise lie more than twelve hours ahead."""
    stamp = combine_local(local_date(observed_at, zone), hhmm, zone)
    return F.when(
        seconds_between(stamp, observed_at) > 12 * 3600, add_minutes(stamp, -1440)
    ).otherwise(stamp)


def midnight_roll(departed: Column, scheduled: Column) -> Column:
    """A departure more than twelve hours before its schedule belongs to the next day."""
    return F.when(
        seconds_between(scheduled, departed) > 12 * 3600, add_minutes(departed, 1440)
    ).otherwise(departed)
