"""Timetable blocks from a raw listing, bad ones set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_NAMES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def timetable_blocks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) from raw(block_no, terminal, route, effective_from, effective_to,
    days array<string>, departures array<string>).

    Day names are cut to three letters; `all`, `daily` or no list at all mean every day.
    """
    tokens = F.transform("days", lambda t: F.substring(F.lower(F.trim(t)), 1, 3))
    every = F.col("days").isNull() | F.array_contains(
        F.transform("days", lambda t: F.lower(F.trim(t)).isin("all", "daily")), True
    )
    numbers = F.transform(
        "_tokens", lambda t: F.array_position(F.array(*[F.lit(d) for d in DAY_NAMES]), t) - 1
    )
    clock = r"^\s*([01]?\d|2[0-3]):([0-5]\d)\s*$"
    checked = raw.withColumn("_tokens", tokens).withColumns(
        {
            "_every": every,
            "_days": F.when(every, F.sequence(F.lit(0), F.lit(6))).otherwise(
                F.array_sort(F.array_distinct(numbers)).cast("array<int>")
            ),
            "_bad_time": F.exists("departures", lambda t: ~F.coalesce(t.rlike(clock), F.lit(False))),
        }
    )
    reason = (
        F.when(~F.col("_every") & (F.size("days") == 0), "empty day list")
        .when(~F.col("_every") & F.array_contains("_days", -1), "unrecognised day")
        .when(F.col("departures").isNull(), "missing departures")
        .when(F.size("departures") == 0, "no departures")
        .when(F.col("_bad_time"), "bad departure time")
        .when(F.col("effective_from").isNull() | F.col("effective_to").isNull(), "bad date")
    )
    judged = checked.withColumn("reason", reason)
    padded = F.transform(
        "departures",
        lambda t: F.concat_ws(
            ":", F.lpad(F.split(F.trim(t), ":")[0], 2, "0"), F.split(F.trim(t), ":")[1]
        ),
    )
    blocks = judged.filter(F.col("reason").isNull()).select(
        "block_no", "terminal", "route", "effective_from", "effective_to",
        F.col("_days").alias("days"), F.array_sort(padded).alias("departures"),
    )
    rejects = judged.filter(F.col("reason").isNotNull()).select("block_no", "terminal", "reason")
    return blocks, rejects
