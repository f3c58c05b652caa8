"""Statutory holidays, day types, seasons and long weekends as Column expressions.

Every floating holiday is "a given weekday inside a fixed span of days", so a date can be
tested on its own month, day and weekday. Nothing here needs a join or a lookup table: the
tests fold into the scan's code generation and cost the same on any number of rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONDAY, FRIDAY, SATURDAY, SUNDAY = 0, 4, 5, 6

# Fixed values: (name, month, first day, last day, weekday or None).
HOLIDAY_RULES = (
    ("New Year's Day", 1, 1, 1, None),
    ("Family Day", 2, 15, 21, MONDAY),
    ("Victoria Day", 5, 18, 24, MONDAY),
    ("Canada Day", 7, 1, 1, None),
    ("BC Day", 8, 1, 7, MONDAY),
    ("Labour Day", 9, 1, 7, MONDAY),
    ("National Day for Truth and Reconciliation", 9, 30, 30, None),
    ("Thanksgiving", 10, 8, 14, MONDAY),
    ("Remembrance Day", 11, 11, 11, None),
    ("Christmas Day", 12, 25, 25, None),
)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def _mod(a: Column, b: int) -> Column:
    return F.pmod(a, F.lit(b)).cast("int")


def nth_weekday(year: Column, month: Column | int, weekday: int, n: int) -> Column:
    """The n-th (from 1) given weekday of a month; Monday is 0."""
    month = F.lit(month) if isinstance(month, int) else month
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, (_mod(F.lit(weekday) - F.weekday(first), 7) + 7 * (n - 1)).cast("int"))


def last_weekday_before(day: Column, weekday: int) -> Column:
    """The latest given weekday strictly before a date."""
    back = _mod(F.weekday(day) - weekday, 7)
    return F.date_sub(day, F.when(back == 0, 7).otherwise(back).cast("int"))


def easter_sunday(year: Column) -> Column:
    """Gauss's rule: days after 21 March, with its two April exceptions."""
    century = _div(year, 100)
    moon = _mod(15 - _div(13 + 8 * century, 25) + century - _div(century, 4), 30)
    week = _mod(4 + century - _div(century, 4), 7)
    golden = _mod(year, 19)
    d = _mod(19 * golden + moon, 30)
    e = _mod(2 * _mod(year, 4) + 4 * _mod(year, 7) + 6 * d + week, 7)
    offset = (
        F.when((d == 29) & (e == 6), 28)
        .when((d == 28) & (e == 6) & (golden > 10), 27)
        .otherwise(d + e)
    )
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), offset.cast("int"))


def is_good_friday(day: Column) -> Column:
    """A Friday two days before the first Sunday after the paschal full moon.

    The moon is counted in days after 21 March, so no date has to be built for the year.
    """
    year = F.year(day)
    century, golden = _div(year, 100), _mod(year, 19)
    shift = 15 + century - _div(century, 4) - _div(8 * century + 13, 25)
    moon = _mod(19 * golden + shift, 30)
    early = (moon == 29) | ((moon == 28) & (golden > 10))
    sunday = F.datediff(day, F.make_date(year, F.lit(3), F.lit(19)))
    gap = sunday - moon + F.when(early, 1).otherwise(0)
    return (F.weekday(day) == FRIDAY) & F.month(day).isin(3, 4) & gap.between(1, 7)


def _rule(month: Column, dom: Column, weekday: Column, m: int, first: int, last: int, wanted) -> Column:
    test = (month == m) & (dom.between(first, last) if first != last else dom == first)
    return test if wanted is None else test & (weekday == wanted)


def holiday_name(day: Column) -> Column:
    """Name of the statutory holiday on a date, or NULL."""
    parts = F.month(day), F.dayofmonth(day), F.weekday(day)
    chain = F.when(is_good_friday(day), F.lit("Good Friday"))
    for name, *rule in HOLIDAY_RULES:
        chain = chain.when(_rule(*parts, *rule), F.lit(name))
    return chain


def is_holiday(day: Column) -> Column:
    """As holiday_name, folded to two compact tests of the date's month and day."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    fixed = [m * 100 + first for _, m, first, _, weekday in HOLIDAY_RULES if weekday is None]
    mondays = F.lit(False)
    for _, m, first, last, weekday in HOLIDAY_RULES:
        if weekday is not None:
            mondays = mondays | md.between(m * 100 + first, m * 100 + last)
    return md.isin(*fixed) | ((F.weekday(day) == MONDAY) & mondays) | is_good_friday(day)


def holidays_of_years(years: DataFrame, year: str = "year") -> DataFrame:
    """The eleven holidays of each year in a table of years, one row each."""
    y = F.col(year)
    entries = [
        F.struct(F.date_sub(easter_sunday(y), 2).alias("day"), F.lit("Good Friday").alias("name"))
    ]
    for name, month, first, _, weekday in HOLIDAY_RULES:
        start = F.make_date(y, F.lit(month), F.lit(first))
        if weekday is not None:
            start = F.date_add(start, _mod(F.lit(weekday) - F.weekday(start), 7))
        entries.append(F.struct(start.alias("day"), F.lit(name).alias("name")))
    return (
        years.select(y.alias("year"))
        .distinct()
        .select("year", F.explode(F.array(*entries)).alias("h"))
        .select("year", F.col("h.day").alias("day"), F.col("h.name").alias("name"))
    )


def day_type(day: Column) -> Column:
    weekday = F.weekday(day)
    return (
        F.when(is_holiday(day) | (weekday == SUNDAY), "sunday_holiday")
        .when(weekday == SATURDAY, "saturday")
        .when(weekday == FRIDAY, "friday")
        .otherwise("weekday")
    )


def season(day: Column) -> Column:
    """Peak summer runs from 25 June through Labour Day itself.

    Within September the Monday of a date's own week tells which side of Labour Day, the
    month's first Monday, it lies on.
    """
    md, weekday = F.month(day) * 100 + F.dayofmonth(day), F.weekday(day)
    monday = F.dayofmonth(day) - weekday
    past_labour_day = (monday >= 1) & ((monday > 7) | (weekday > MONDAY))
    september = md.between(901, 930)
    return (
        F.when(md.between(625, 831) | (september & ~past_labour_day), "peak_summer")
        .when(md.between(401, 624) | september | md.between(1001, 1031), "shoulder")
        .otherwise("winter")
    )


def is_long_weekend(day: Column) -> Column:
    """A Saturday counts only through a Monday holiday; a Sunday also after Good Friday."""
    weekday = F.weekday(day)
    monday_after = F.date_add(day, F.pmod(7 - weekday, F.lit(7)).cast("int"))
    return (
        is_holiday(day)
        | (weekday.isin(FRIDAY, SATURDAY, SUNDAY) & is_holiday(monday_after))
        | ((weekday == SUNDAY) & is_holiday(F.date_sub(day, 2)))
    )


def day_tags(day: Column) -> Column:
    """Automatic tags of a date: the holiday it is, and whether it is a long weekend."""
    name = holiday_name(day)
    return F.array_compact(
        F.array(
            F.when(name.isNotNull(), F.concat(F.lit("holiday:"), name)),
            F.when(is_long_weekend(day), F.lit("long_weekend")),
        )
    )


@lru_cache(maxsize=64)
def calendar_columns(day: str) -> dict[str, Column]:
    """The three calendar columns of a named date column; built once per name."""
    d = F.col(day)
    return {"day_type": day_type(d), "season": season(d), "long_weekend": is_long_weekend(d)}


def with_calendar(df: DataFrame, day: str = "service_date") -> DataFrame:
    """Add day_type, season and long_weekend."""
    return df.withColumns(calendar_columns(day))
