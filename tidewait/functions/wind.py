"""Wind sentences as numbers, bands and a short reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compass words and their short forms.
DIRECTIONS = (
    ("northwest", "NW"), ("northeast", "NE"), ("southwest", "SW"), ("southeast", "SE"),
    ("north", "N"), ("south", "S"), ("east", "E"), ("west", "W"),
)
# Words that stand for a speed when no number is given, most severe first.
NAMED_SPEEDS = (("hurricane", 64), ("storm", 48), ("gale", 34), ("strong wind", 20), ("light", 10))
# Warning thresholds in knots.
WARNING_BANDS = ((48, "storm"), (34, "gale"), (20, "strong"), (0, "light"))
# How speeds are written, and the fastest that is believed.
NUMBER = r"\b(\d{1,3})\b"
SPAN = r"\b(\d{1,3})\s+to\s+(\d{1,3})\b"
FASTEST = 150  # knots; larger numbers are no wind speeds


def _named(lowered: Column, value) -> Column:
    chain = F.when(lowered.contains(NAMED_SPEEDS[0][0]), value(*NAMED_SPEEDS[0]))
    for word, floor in NAMED_SPEEDS[1:]:
        chain = chain.when(lowered.contains(word), value(word, floor))
    return chain


def wind_speed(wind: Column, fastest: int = FASTEST) -> Column:
    """Strongest believable number in the sentence, else what its own word stands for."""
    numbers = F.transform(
        F.regexp_extract_all(wind, F.lit(NUMBER), F.lit(1)), lambda n: n.cast("int")
    )
    strongest = F.array_max(F.filter(numbers, lambda n: n <= fastest))
    return F.coalesce(strongest, _named(F.lower(wind), lambda _, floor: F.lit(floor)))


def wind_band(knots: Column) -> Column:
    chain = F.when(knots.isNull(), "unknown")
    for floor, name in WARNING_BANDS:
        chain = chain.when(knots >= floor, name)
    return chain.otherwise("light")


def wind_brief(wind: Column, fastest: int = FASTEST) -> Column:
    """The direction and the speed the sentence opens with; NULL when it has neither."""
    lowered = F.lower(wind)
    found = F.array(
        *[
            F.struct(
                F.instr(lowered, word).alias("at"), F.lit(-len(word)).alias("length"),
                F.lit(short).alias("short"),
            )
            for word, short in DIRECTIONS
        ]
    )
    direction = F.array_min(F.filter(found, lambda d: d["at"] > 0))["short"]
    numbers = F.filter(
        F.regexp_extract_all(wind, F.lit(NUMBER), F.lit(1)), lambda n: n.cast("int") <= fastest
    )
    single = F.try_element_at(numbers, F.lit(1))
    single_at = F.regexp_instr(wind, F.concat(F.lit(r"\b"), single, F.lit(r"\b")))
    low, high = F.regexp_extract(wind, SPAN, 1), F.regexp_extract(wind, SPAN, 2)
    span_at = F.regexp_instr(wind, F.lit(SPAN))
    spanned = (span_at > 0) & (high.try_cast("int") <= fastest) & (single.isNull() | (span_at <= single_at))
    speed = (
        F.when(F.coalesce(spanned, F.lit(False)), F.concat(low, F.lit("–"), high, F.lit(" kt")))
        .when(single.isNotNull(), F.concat(single, F.lit(" kt")))
        .otherwise(_named(lowered, lambda word, _: F.lit(word)))
    )
    return F.nullif(F.concat_ws(" ", direction, speed), F.lit(""))


# Weekday names as forecasts spell them.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def next_weekday(day: Column, name: Column) -> Column:
    """Next date of that weekday strictly after `day`; NULL for an unknown name."""
    def dated(number: Column) -> Column:
        ahead = F.pmod(number - F.weekday(day), F.lit(7))
        return F.when(number >= 0, F.date_add(day, F.when(ahead == 0, 7).otherwise(ahead).cast("int")))

    # Bound by a lambda, so that the name is looked up once.
    number = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), name) - 1
    return F.transform(F.array(number), dated)[0]


def period_date(label: Column, issued: Column) -> tuple[Column, Column]:
    """(date, day or night) a period label names; both NULL when it names none."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    today = text.isin("today", "tonight") | text.startswith("this ")
    date = F.when(today, issued).otherwise(next_weekday(issued, F.split(text, r"\s+")[0]))
    half = F.when(today, F.when(text == "tonight", "night").otherwise("day")).otherwise(
        F.when(text.endswith("night"), "night").otherwise("day")
    )
    return date, F.when(date.isNotNull(), half)
