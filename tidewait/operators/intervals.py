"""Joins between instants and spans of time, always on equality keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import add_minutes, seconds_apart
from tidewait.params import Params

HOUR = 3600


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(width)).cast("long")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str,
                  end: str, *, salts: int = 1, width: int = HOUR, how: str = "inner") -> DataFrame:
    """Points inside [start, end] of each span with equal `keys`, both ends inclusive.

    Spans are the small side: each is repeated for the hours it touches, while a point stays
    in the single hour it lies in, so no pair can meet twice. The join key is (keys, hour,
    salt): a crowded hour of one terminal is spread over `salts` tasks, the span being copied
    to each. Both sides keep ordinary shuffle joins; nothing is forced to broadcast. Where
    both sides have a column of one name, the span's stays.
    """
    shared = [c for c in points.columns if c in spans.columns and c not in keys]
    salted = points.drop(*shared).withColumns(
        {
            "_hour": _bucket(F.col(at), width),
            "_salt": F.pmod(F.xxhash64(F.col(at)), F.lit(salts)).cast("int"),
        }
    )
    copies = spans.withColumns(
        {
            "_hour": F.explode(
                F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))
            ),
        }
    ).withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = copies.join(salted, [*keys, "_hour", "_salt"], how)
    return joined.filter(F.col(at).between(F.col(start), F.col(end))).drop("_hour", "_salt")


def interval_fold_rows(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, *,
                       salts: int = 1, width: int = HOUR) -> DataFrame:
    """interval_join for a fold that must not lose a span: every span stays, and a point outside it is all NULL.

    So whatever a span carries goes through the one join and the one grouping behind it, and need not be computed a second time
    to be joined back. A span has a row without a point for each of its copies that meets none."""
    own = [c for c in points.columns if c not in keys and c not in spans.columns]
    salted = points.select(*keys, *own).withColumns(
        {"_hour": _bucket(F.col(at), width), "_salt": F.pmod(F.xxhash64(F.col(at)), F.lit(salts)).cast("int")}
    )
    first, last = _bucket(F.col(start), width), _bucket(F.col(end), width)
    copies = spans.withColumn("_hour", F.explode(F.sequence(first, F.greatest(first, last))))
    copies = copies.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = copies.join(salted, [*keys, "_hour", "_salt"], "left").drop("_hour", "_salt")
    inside = F.coalesce(F.col(at).between(F.col(start), F.col(end)), F.lit(False))
    return joined.select(*spans.columns, *[F.when(inside, F.col(c)).alias(c) for c in own])


def unique_frames(frames: DataFrame) -> DataFrame:
    """First stored row of each (terminal, camera, captured_at); the archive's unique key.

    It bounds every later group: one camera adds at most one row per second.
    """
    rest = [c for c in frames.columns if c not in ("terminal", "camera", "captured_at")]
    return (
        frames.groupBy("terminal", "camera", "captured_at")
        .agg(F.min_by(F.struct(*rest), F.col("frame_id")).alias("row"))
        .select("terminal", "camera", "captured_at", "row.*")
    )


def readable_frames(frames: DataFrame, camera: str | None = "main") -> DataFrame:
    """Stored frames with a file, of one camera unless told otherwise."""
    kept = frames.filter((F.col("status") == "ok") & F.col("path").isNotNull())
    return kept if camera is None else kept.filter(F.col("camera") == camera)


def without_reading(frames: DataFrame, readings: DataFrame, version: str) -> DataFrame:
    """Frames no reading of this version exists for."""
    read = readings.filter(F.col("version") == version).select("frame_id").distinct()
    return frames.join(read, "frame_id", "left_anti")


def frames_between(frames: DataFrame, readings: DataFrame | None, version: str, *,
                   terminal: str, start: Column, end: Column, camera: str = "main") -> DataFrame:
    found = readable_frames(frames, camera).filter(
        (F.col("terminal") == terminal) & F.col("captured_at").between(start, end)
    )
    return found if readings is None else without_reading(found, readings, version)


def pending_readings(frames: DataFrame, readings: DataFrame, version: str, limit: int, *,
                     terminals: list[str] | None = None, camera: str | None = "main",
                     since: Column | None = None) -> DataFrame:
    """Oldest frames still unread by one version."""
    found = without_reading(readable_frames(frames, camera), readings, version)
    if terminals is not None:
        found = found.filter(F.col("terminal").isin(*terminals))
    if since is not None:
        found = found.filter(F.col("captured_at") >= since)
    return found.orderBy("captured_at", "frame_id").limit(limit)


def frames_for_services(services: DataFrame, frames: DataFrame, params: Params) -> DataFrame:
    """Every frame within [departure - lookback, departure + post window]."""
    spans = services.withColumns(
        {
            "terminal": F.col("origin"),
            "window_start": add_minutes(F.col("scheduled"), -params.lookback_minutes),
            "window_end": add_minutes(F.col("scheduled"), params.post_window_minutes),
        }
    )
    return interval_join(frames, spans, ["terminal"], "captured_at", "window_start", "window_end",
                         salts=params.salts)


def nearest_frames(services: DataFrame, frames: DataFrame, params: Params) -> DataFrame:
    """For each service and offset the frame nearest to the target, ties to the earlier one.

    One row per (service, offset) that has a frame within the tolerance.
    """
    tolerance = params.essential_tolerance_minutes
    targets = services.select(
        *[c for c in services.columns],
        F.explode(F.array(*[F.lit(o) for o in params.essential_offsets])).alias("offset"),
    ).withColumn("target", add_minutes(F.col("scheduled"), F.col("offset")))
    spans = targets.withColumns(
        {
            "terminal": F.col("origin"),
            "window_start": add_minutes(F.col("target"), -tolerance),
            "window_end": add_minutes(F.col("target"), tolerance),
        }
    )
    pairs = interval_join(frames, spans, ["terminal"], "captured_at", "window_start", "window_end",
                          salts=params.salts)
    return pairs.groupBy("route", "origin", "service_date", "depart_hhmm", "scheduled", "offset").agg(
        F.min_by(
            F.struct("frame_id", "captured_at"),
            F.struct(seconds_apart(F.col("captured_at"), F.col("target")),
                     F.col("captured_at"), F.col("frame_id")),
        ).alias("nearest")
    ).select(
        "route", "origin", "service_date", "depart_hhmm", "scheduled", "offset",
        F.col("nearest.frame_id").alias("frame_id"),
        F.col("nearest.captured_at").alias("captured_at"),
    )


def essential_frames(services: DataFrame, frames: DataFrame, params: Params) -> DataFrame:
    """The distinct frames worth reading, in whatever service they serve."""
    return nearest_frames(services, frames, params).select("frame_id", "captured_at").distinct()


def service_windows(services: DataFrame, params: Params) -> DataFrame:
    """Each service's evidence window, cut short by its neighbours.

    Needs previous_departure and next_departure.
    """
    scheduled = F.col("scheduled")
    return services.withColumns(
        {
            "window_start": F.greatest(
                add_minutes(scheduled, -params.lookback_minutes),
                add_minutes(F.col("previous_departure"), params.settle_minutes),
            ),
            "window_end": F.least(
                add_minutes(scheduled, params.post_window_minutes),
                add_minutes(F.col("next_departure"), -params.neighbour_gap_minutes),
            ),
        }
    )


def readings_in_window(services: DataFrame, readings: DataFrame, params: Params) -> DataFrame:
    """Usable readings of the origin inside each service's window."""
    spans = service_windows(services, params).withColumn("terminal", F.col("origin")).filter(
        F.col("window_start") <= F.col("window_end")
    )
    usable = readings.filter(F.col("usable"))
    return interval_join(usable, spans, ["terminal"], "captured_at", "window_start", "window_end",
                         salts=params.salts)


def services_with_readings(services: DataFrame, readings: DataFrame, params: Params) -> DataFrame:
    """As readings_in_window, with every service kept: one without a reading has rows whose reading is NULL."""
    spans = service_windows(services, params).withColumn("terminal", F.col("origin"))
    return interval_fold_rows(readings.filter(F.col("usable")), spans, ["terminal"], "captured_at", "window_start", "window_end",
                              salts=params.salts)


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                     rank: str = "rank") -> DataFrame:
    """The first n rows per group; Spark keeps only n per task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rank) <= n
    )


def recent_frames(frames: DataFrame, now: Column, params: Params, *, camera: str | None = None) -> DataFrame:
    """Newest frames per camera not older than the on-demand age."""
    fresh = readable_frames(frames, camera).filter(
        F.col("captured_at").between(add_minutes(now, -params.on_demand_age_minutes), now)
    )
    return newest_per_group(
        fresh, ["terminal", "camera"],
        [F.col("captured_at").desc(), F.col("frame_id").desc()], params.on_demand_frames,
    )
