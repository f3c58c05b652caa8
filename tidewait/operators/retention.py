"""Which image files may go. These operators only name frames; deleting is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import add_minutes
from tidewait.operators.intervals import essential_frames, readable_frames
from tidewait.params import Params

MINUTES_PER_DAY = 1440


def _days_before(now: Column, days: int) -> Column:
    return add_minutes(now, -days * MINUTES_PER_DAY)


def read_frames(readings: DataFrame, versions: list[str]) -> DataFrame:
    return readings.filter(F.col("version").isin(*versions)).select("frame_id").distinct()


def expired_frames(frames: DataFrame, readings: DataFrame, now: Column, params: Params,
                   keep_unread: bool = True) -> DataFrame:
    """Files past the horizon; by default only those a reader has looked at."""
    stored = frames.filter(F.col("path").isNotNull())
    old = stored.filter(F.col("captured_at") < _days_before(now, params.keep_days))
    if not keep_unread:
        return old
    read = read_frames(readings, [params.model_version, params.extent_version])
    return old.join(read, "frame_id", "left_semi")


def held_back_frames(frames: DataFrame, readings: DataFrame, now: Column, params: Params) -> DataFrame:
    """Aged frames kept only because nobody has read them."""
    aged = frames.filter(
        F.col("path").isNotNull()
        & (F.col("captured_at") < _days_before(now, params.thin_after_days))
    )
    read = read_frames(readings, [params.model_version, params.extent_version])
    return aged.join(read, "frame_id", "left_anti")


def hourly_surplus(frames: DataFrame, readings: DataFrame, now: Column, params: Params) -> DataFrame:
    """Middle-aged read frames beyond the first few of their camera's hour.

    One camera stores at most a frame per second, so an hour's window is short by nature.
    """
    aged = frames.filter(
        F.col("path").isNotNull()
        & (F.col("captured_at") < _days_before(now, params.thin_after_days))
        & (F.col("captured_at") >= _days_before(now, params.keep_days))
    )
    read = read_frames(readings, [params.model_version, params.extent_version])
    hour = W.partitionBy("terminal", "camera", "_hour").orderBy("captured_at", "frame_id")
    return (
        aged.join(read, "frame_id", "left_semi")
        .withColumn("_hour", F.date_trunc("hour", "captured_at"))
        .withColumn("place", F.row_number().over(hour))
        .filter(F.col("place") > params.keep_per_hour)
        .drop("_hour")
    )


def thinned_unread(frames: DataFrame, readings: DataFrame, services: DataFrame, now: Column,
                   params: Params) -> DataFrame:
    """Aged unread main-camera frames that no service's essential offsets would pick.

    Keepers are chosen among all frames, read or not, so reading one later changes nothing.
    """
    aged = frames.filter(
        F.col("path").isNotNull() & (F.col("camera") == "main")
        & (F.col("captured_at") < _days_before(now, params.thin_unread_after_days))
    )
    unread = aged.join(read_frames(readings, [params.model_version]), "frame_id", "left_anti")
    keep = essential_frames(services, readable_frames(frames), params).select("frame_id")
    return unread.join(keep, "frame_id", "left_anti")
