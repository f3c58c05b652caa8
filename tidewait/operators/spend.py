"""What reading costs, and where it stops."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.params import Params


def cost_micros(input_tokens: Column, output_tokens: Column, params: Params) -> Column:
    """Cost in millionths of a dollar, rounded; prices are exact decimals, cents and less included."""
    price_in, price_out = (F.lit(Decimal(str(p))) for p in (params.usd_per_m_input, params.usd_per_m_output))
    return F.round(input_tokens.cast("long") * price_in + output_tokens.cast("long") * price_out).cast("long")


def cost_usd(input_tokens: Column, output_tokens: Column, params: Params) -> Column:
    return (
        input_tokens * F.lit(params.usd_per_m_input) + output_tokens * F.lit(params.usd_per_m_output)
    ) / F.lit(1e6)


def daily_spend(reads: DataFrame, params: Params) -> DataFrame:
    """Per day: reads, cost, cost since the start of its month, and what the daily cap leaves.

    The cap counts frames read by any path; `frames_left` is NULL without a cap and never below 0, as paths that are
    not capped may have gone past it."""
    cap = params.daily_frame_cap
    day = F.to_date("created_at")
    days = reads.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("reads"), F.sum("cost_micros").alias("day_micros")
    )
    month = (
        W.partitionBy(F.date_trunc("month", F.col("day"))).orderBy("day")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return days.withColumn("month_micros", F.sum("day_micros").over(month)).select(
        "day", "reads", (F.col("day_micros") / 1e6).alias("day_usd"),
        (F.col("month_micros") / 1e6).alias("month_usd"),
        (F.lit(None).cast("bigint") if cap is None else F.greatest(F.lit(cap) - F.col("reads"), F.lit(0)).cast("bigint")).alias("frames_left"),
    )


def within_daily_cap(reads: DataFrame, levels: list[str], order: list[Column], params: Params) -> DataFrame:
    """The reads a day has room for: the first so many of each, in processing order. Every task cuts its share
    of a day before the shuffle. The first two levels are month and day."""
    if params.daily_frame_cap is None:
        return reads
    place = F.row_number().over(W.partitionBy(*levels[:2]).orderBy(*levels[2:], *order))
    return reads.withColumn("_place", place).filter(F.col("_place") <= params.daily_frame_cap).drop("_place")


def admitted(reads: DataFrame, levels: list[str], order: list[Column], params: Params) -> DataFrame:
    """Reads processed under both limits, in order: the day's cap of frames and the month's budget.

    A read the day refuses costs the month nothing. Once a month is spent it admits no more, and up to there a day
    has admitted all it had room for; so the cap can be applied first, and the budget to what is left."""
    return within_budget(within_daily_cap(reads, levels, order, params), levels, order, params)


def group_offsets(df: DataFrame, levels: list[str], value: str, name: str) -> DataFrame:
    """One row per finest group with the sum of `value` over all earlier groups of its first level.

    `levels` run from coarse to fine and sort in that order. The rows are summed once to the
    finest groups; every further step works on those sums and accumulates inside one parent
    only, so no task ever holds more than one parent's children.
    """
    fine = df.groupBy(*levels).agg(F.sum(value).alias("_sum"))
    offsets = fine.select(*levels)
    names = []
    for depth in range(1, len(levels)):
        parent, here = levels[:depth], levels[: depth + 1]
        names.append(f"_before_{depth}")
        earlier = W.partitionBy(*parent).orderBy(levels[depth]).rowsBetween(W.unboundedPreceding, -1)
        sums = fine if depth == len(levels) - 1 else fine.groupBy(*here).agg(F.sum("_sum").alias("_sum"))
        before = sums.select(*here, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(names[-1]))
        offsets = offsets.join(before, here)
    total = F.lit(0).cast("bigint")
    for n in names:
        total = total + F.col(n)
    return offsets.select(*levels, total.alias(name))


def within_budget(reads: DataFrame, levels: list[str], order: list[Column], params: Params) -> DataFrame:
    """Rows processed before each first-level period's spend reaches the budget.

    The row that reaches it is still processed; the first one after it is not. Groups that
    start past the budget drop out before any row of theirs is sorted. A budget of 0 is no budget:
    every row is processed.
    """
    budget = int(round(params.monthly_budget_usd * 1e6))
    offsets = group_offsets(reads, levels, "cost_micros", "_offset")
    if budget:
        offsets = offsets.filter(F.col("_offset") < budget)
    inside = W.partitionBy(*levels).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        reads.join(offsets, levels)
        .withColumn(
            "spent_before", F.col("_offset") + F.coalesce(F.sum("cost_micros").over(inside), F.lit(0))
        )
        .filter(F.col("spent_before") < budget if budget else F.lit(True))
        .drop("_offset")
    )
