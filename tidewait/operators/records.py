"""Reports over finished records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewait.functions.calendar import day_tags
from tidewait.functions.claims import evidence_kind, evidence_of
from tidewait.params import OUTCOMES


def outcome_totals(records: DataFrame, keys: list) -> DataFrame:
    """Counts of all six outcomes per key, zeros included."""
    return records.groupBy(*keys).agg(
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    )


def tags_per_date(dates: DataFrame, manual: DataFrame) -> DataFrame:
    """Sorted distinct automatic and manual tags of each date.

    dates(service_date), manual(service_date, tag). Pairs are made distinct before they are
    gathered, so a date gathers its tags and not its rows.
    """
    days = dates.select("service_date").distinct()
    automatic = days.select("service_date", F.explode(day_tags(F.col("service_date"))).alias("tag"))
    asked = manual.join(days, "service_date", "left_semi").select("service_date", "tag")
    tags = automatic.unionByName(asked).distinct().groupBy("service_date").agg(
        F.array_sort(F.collect_list("tag")).alias("tags")
    )
    return days.join(tags, "service_date", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def evidence_per_group(records: DataFrame, keys: list[str]) -> DataFrame:
    """The one kind of evidence behind each group's records, or `mixed` or `unknown`."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        evidence_of(F.collect_set(evidence_kind(F.col("method")))).alias("evidence"),
    )
