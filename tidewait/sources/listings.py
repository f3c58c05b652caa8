"""What a published listing offers and what of it is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CAMERA = ["terminal", "camera"]


def index_moments(indexes: DataFrame, stamp_format: str) -> DataFrame:
    """Distinct timestamps of each camera's index, a JSON array of texts.

    Entries that are no text or no timestamp are left out; index_errors names indexes without any.
    """
    entries = F.from_json("payload", "array<string>")
    return (
        indexes.select(*CAMERA, F.explode(entries).alias("entry"))
        .select(*CAMERA, F.try_to_timestamp("entry", F.lit(stamp_format)).alias("captured_at"))
        .filter(F.col("captured_at").isNotNull())
        .distinct()
    )


def index_errors(indexes: DataFrame, stamp_format: str) -> DataFrame:
    """Indexes refused as a whole, with the reason: no list, or nothing in it that can be read as a time."""
    entries = F.from_json("payload", "array<string>")
    stamps = F.filter(F.transform(entries, lambda e: F.try_to_timestamp(e, F.lit(stamp_format))), lambda t: t.isNotNull())
    reason = F.when(entries.isNull(), "index is no list").when(F.size(stamps) == 0, "index holds no readable time")
    return indexes.withColumn("error", reason).filter(F.col("error").isNotNull())


def replay_missing(offered: DataFrame, frames: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(missing, totals). Only stored good frames are held, so failed ones are retried.

    All missing moments are returned; those beyond the newest `limit` of a camera are marked
    `deferred` to the next sweep, and the totals count them.
    """
    held = frames.filter(F.col("status") == "ok").select(*CAMERA, "captured_at").distinct()
    missing = offered.join(held, [*CAMERA, "captured_at"], "left_anti")
    newest = W.partitionBy(*CAMERA).orderBy(F.col("captured_at").desc())
    fetch = (
        missing.withColumn("place", F.row_number().over(newest))
        .withColumn("deferred", F.col("place") > limit)
        .drop("place")
    )
    counted = missing.groupBy(*CAMERA).agg(F.count(F.lit(1)).alias("missing"))
    totals = (
        offered.groupBy(*CAMERA).agg(F.count(F.lit(1)).alias("offered"))
        .join(counted, CAMERA, "left")
        .select(
            *CAMERA, "offered",
            (F.col("offered") - F.coalesce("missing", F.lit(0))).alias("already_held"),
            F.greatest(F.coalesce("missing", F.lit(0)) - limit, F.lit(0)).alias("capped"),
        )
    )
    return fetch, totals


def newest_documents(listing: DataFrame, now_hour: Column, pattern: str, lookback: int = 12) -> DataFrame:
    """Newest listed name per (site, lang) within the lookback: the latest hour holding one,
    then the latest name.

    listing(hour, name) with hour a timestamp; `pattern` has groups (site, lang).
    """
    named = listing.select(
        "hour", "name",
        F.regexp_extract("name", pattern, 1).alias("site"),
        F.regexp_extract("name", pattern, 2).alias("lang"),
    ).filter(F.col("site") != "")
    reach = named.filter(
        F.col("hour").between(F.timestamp_add("HOUR", F.lit(-lookback), now_hour), now_hour)
    )
    return reach.groupBy("site", "lang").agg(
        F.max("hour").alias("hour"), F.max_by("name", F.struct("hour", "name")).alias("name")
    )
