"""Queue readings from camera pixels.

A frame is (frame_id, terminal, camera, captured_at, pixels array<int>), row-major grey
values. Samples and quotas are chosen on metadata; pixels move once to meet their camera's
background. Measuring is array arithmetic on Arrow batches, and no plan has a row per pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewait.functions.clock import local_time
from tidewait.params import Params

# Thresholds of the two readers.
LANE_DIFF, LANE_SHARE = 22, 0.15
ROW_DIFF, ROW_SHARE = 30, 0.60
RUN_DENSITY, MIN_RUN_ROWS = 0.70, 8
MIN_VEHICLES = 4.0
LIGHT_LOW, LIGHT_HIGH = 0.85, 1.20
MAX_DRIFT = 3.0
BRIGHT = 0.90
OTHER_SIZE = "frame of another size than its reference"

BUCKET = ["terminal", "camera", "hour"]


def _rows(lists: pa.Array) -> list[np.ndarray]:
    """Each value of a list column as an array, nothing copied; null counts as empty."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(lists) else []


@F.arrow_udf(T.ArrayType(T.ShortType()))
def _grey(data: pa.Array, channels: pa.Array) -> pa.Array:
    """Grey values of decoded image bytes; colour comes blue, green, red."""

    def one(raw: bytes, n: int) -> np.ndarray:
        flat = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n).astype(np.int32)
        if n == 1:
            return flat[:, 0].astype(np.int16)
        b, g, r = flat[:, 0], flat[:, 1], flat[:, 2]
        return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.int16)

    return pa.array([one(d, n) for d, n in zip(data.to_pylist(), channels.to_pylist(), strict=True)], pa.list_(pa.int16()))


def luma_frames(images: DataFrame) -> DataFrame:
    """Grey pixels of Spark's decoded `image` column."""
    return images.select(
        *[c for c in images.columns if c != "image"],
        F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        _grey(F.col("image.data"), F.col("image.nChannels")).alias("pixels"),
    )


def mean_luma(pixels: Column) -> Column:
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, p: a + p)
    return total / F.size(pixels)


def with_darkness(frames: DataFrame, params: Params) -> DataFrame:
    return frames.withColumn("mean_luma", mean_luma(F.col("pixels"))).withColumn(
        "dark", F.col("mean_luma") < params.dark_luma
    )


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """All rows of a small group, `limit` evenly spaced ones of a larger group.

    Row number r (from 0) of n is taken when some i has floor(i * n / limit) = r.
    """
    group = W.partitionBy(*keys)
    placed = df.withColumns(
        {
            "_place": F.row_number().over(group.orderBy(*order)) - 1,
            "_all": F.count(F.lit(1)).over(group),
        }
    )
    # The smallest i that reaches this row, and whether it stays short of the next.
    i = F.ceil(F.col("_place") * limit / F.col("_all"))
    taken = (F.col("_all") <= limit) | (
        (i < limit) & (F.floor(i * F.col("_all") / limit) == F.col("_place"))
    )
    return placed.filter(taken).drop("_place").withColumnRenamed("_all", "offered")


def background_offers(frames: DataFrame, now: Column, params: Params) -> DataFrame:
    """Frames each camera-hour offers for its background, and whether they are enough; metadata only."""
    recent = frames.filter(
        F.col("captured_at").between(F.timestamp_add("DAY", F.lit(-params.background_days), now), now)
    ).withColumn("hour", F.hour(local_time(F.col("captured_at"), params.zone)))
    return recent.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("offered")).withColumn(
        "enough", F.col("offered") >= params.min_background_frames
    )


def background_sample(frames: DataFrame, now: Column, params: Params) -> DataFrame:
    """Which frames make each camera-hour's background; metadata only. Camera-hours that offer too
    few are left out; background_offers lists them."""
    recent = frames.filter(
        F.col("captured_at").between(F.timestamp_add("DAY", F.lit(-params.background_days), now), now)
    ).withColumn("hour", F.hour(local_time(F.col("captured_at"), params.zone)))
    return evenly_spaced(
        recent.select(*BUCKET, "captured_at", "frame_id"), BUCKET, ["captured_at", "frame_id"], params.max_background_frames
    ).filter(F.col("offered") >= params.min_background_frames)


def _median(table: pa.Table) -> pa.Table:
    """The upper median of each pixel over the frames of one camera-hour that have its usual size."""
    table = table.combine_chunks()
    frames = _rows(table.column("pixels").combine_chunks())
    sizes, often = np.unique([len(f) for f in frames], return_counts=True)
    alike = np.stack([f for f in frames if len(f) == sizes[often.argmax()]])
    middle = len(alike) // 2
    value = np.partition(alike, middle, axis=0)[middle].astype(np.int32)
    return pa.table(
        [*(table.column(c).slice(0, 1) for c in BUCKET), pa.array([value], pa.list_(pa.int32())), pa.array([len(alike)], pa.int64())],
        [*BUCKET, "background", "samples"],
    )


def hourly_background(sample: DataFrame, frames: DataFrame) -> DataFrame:
    """Per camera and hour the upper median of each pixel over the sampled frames.

    A task holds the frames of one camera-hour, which the sample bounds.
    """
    picked = sample.select(*BUCKET, "frame_id").join(frames.select("frame_id", "pixels"), "frame_id")
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in BUCKET)
    return picked.select(*BUCKET, "pixels").groupBy(*BUCKET).applyInArrow(_median, f"{kinds}, background array<int>, samples long")


@F.arrow_udf(T.StructType([T.StructField("seen", T.DoubleType()), T.StructField("ref", T.DoubleType())]))
def _bright_levels(pixels: pa.Array, background: pa.Array, positions: pa.Array) -> pa.Array:
    """The 90th percentile of chosen pixels of a frame and its background, the index cut down."""
    seen, ref = [], []
    for image, usual, at in zip(_rows(pixels), _rows(background), _rows(positions), strict=True):
        if not len(at) or len(image) != len(usual) or at.max() >= len(image):
            seen.append(None)
            ref.append(None)
            continue
        index = int(BRIGHT * (len(at) - 1))
        seen.append(float(np.partition(image[at], index)[index]))
        ref.append(float(np.partition(usual[at], index)[index]))
    return pa.StructArray.from_arrays([pa.array(seen, pa.float64()), pa.array(ref, pa.float64())], ["seen", "ref"])


def with_illumination(frames: DataFrame, positions: Column) -> DataFrame:
    """Add light_ratio (frame over background), scale and lit, the gate on the ratio.

    Needs pixels and background; positions are those the light is measured on. All three are NULL
    for a frame of another size than its background: nothing can be measured on it.
    """
    lit = frames.withColumn("_light", _bright_levels("pixels", "background", positions))
    seen, ref = F.col("_light.seen"), F.col("_light.ref")
    return lit.withColumns(
        {
            "light_ratio": F.when(ref != 0, seen / ref).when(ref == 0, F.lit(0.0)),
            "scale": F.when(seen != 0, ref / seen).when(seen == 0, F.lit(1.0)),
        }
    ).withColumn("lit", F.col("light_ratio").between(LIGHT_LOW, LIGHT_HIGH)).drop("_light")


def _changed(threshold: int):
    """Share of each group's positions whose scaled, capped value differs from the background."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def changed(pixels: pa.Array, background: pa.Array, scale: pa.Array, groups: pa.Array) -> pa.Array:
        places = groups.flatten()
        sizes = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = places.flatten().to_numpy(zero_copy_only=False)
        counts = groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        shares: list[np.ndarray | None] = []
        group = at = 0
        for image, usual, factor, n in zip(_rows(pixels), _rows(background), scale.to_pylist(), counts.tolist(), strict=True):
            size = sizes[group : group + n]
            here = flat[at : at + int(size.sum())]
            group, at = group + n, at + len(here)
            if factor is None or len(image) != len(usual) or (len(here) and here.max() >= len(image)):
                shares.append(None)
                continue
            value = np.minimum(255, np.floor(image[here] * factor).astype(np.int64))
            hits = np.concatenate([[0], np.cumsum(np.abs(value - usual[here]) > threshold)])
            ends = np.cumsum(size)
            shares.append((hits[ends] - hits[ends - size]) / np.maximum(size, 1))
        return pa.array(shares, pa.list_(pa.float64()))

    return changed


_LANES_CHANGED, _ROWS_CHANGED = _changed(LANE_DIFF), _changed(ROW_DIFF)


def lane_shares(frames: DataFrame) -> DataFrame:
    """Add shares, array<struct<lane, share>>, from lanes array<struct<lane, positions>>."""
    parts = frames.withColumn("_parts", _LANES_CHANGED("pixels", "background", "scale", F.col("lanes.positions")))
    return parts.withColumn(
        "shares", F.zip_with("lanes", "_parts", lambda lane, part: F.struct(lane["lane"].alias("lane"), part.alias("share")))
    ).drop("_parts")


def lane_reading(frames: DataFrame) -> DataFrame:
    """Add occupied lanes, the band they make and whether the lowest lane is taken.

    covers_compound and lanes_before_capacity say what bare lanes are allowed to mean.
    """
    used = F.transform(F.filter("shares", lambda s: s["share"] > LANE_SHARE), lambda s: s["lane"])
    lowest = F.array_min(F.transform("shares", lambda s: s["lane"]))
    n, all_lanes = F.size("occupied"), F.size("shares")
    part = n / F.nullif(all_lanes, F.lit(0))
    whole = (
        F.when(n == 0, "empty")
        .when(part <= 0.25, "light")
        .when(part <= 0.55, "moderate")
        .when(part < 1.0, "heavy")
        .otherwise("overflowing")
    )
    partly = F.when(
        all_lanes > 0,
        F.when(n > 0, "heavy").when(F.col("lanes_before_capacity"), "empty"),
    )
    return frames.withColumn("occupied", used).withColumns(
        {
            "lanes_occupied": n,
            "band": F.when(F.col("covers_compound"), whole).otherwise(partly),
            "reaches_last_lane": F.coalesce(F.array_contains("occupied", lowest), F.lit(False)),
        }
    )


def row_shares(frames: DataFrame) -> DataFrame:
    """Add row_shares, array<struct<row, share>>, from rows array<struct<row, positions>>."""
    parts = frames.withColumn("_parts", _ROWS_CHANGED("pixels", "background", "scale", F.col("rows.positions")))
    return parts.withColumn(
        "row_shares", F.zip_with("rows", "_parts", lambda row, part: F.struct(row["row"].alias("row"), part.alias("share")))
    ).drop("_parts")


def tail_row(shares: Column) -> Column:
    """Furthest row the queue can be shown to reach, from array<struct<row, share>>.

    Walked from the nearest (largest) row outward, keeping the furthest row behind which
    seven tenths of at least eight rows are taken.
    """
    outward = F.reverse(F.array_sort(shares))
    start = F.struct(
        F.lit(0).alias("seen"), F.lit(0).alias("hits"), F.lit(None).cast("int").alias("row")
    )

    def step(a: Column, s: Column) -> Column:
        seen, hits = a["seen"] + 1, a["hits"] + F.when(s["share"] > ROW_SHARE, 1).otherwise(0)
        reached = (seen >= MIN_RUN_ROWS) & (hits / seen >= RUN_DENSITY)
        return F.struct(
            seen.alias("seen"), hits.alias("hits"),
            F.when(reached, s["row"].cast("int")).otherwise(a["row"]).alias("row"),
        )

    return F.aggregate(outward, start, step)["row"]


def vehicles_at(row: Column, camera_row: Column, horizon: Column, scale: Column) -> Column:
    """Vehicles between the camera and a row, on flat ground."""
    return scale / (row - horizon) - scale / (camera_row - horizon)


def extent_reading(frames: DataFrame) -> DataFrame:
    """Add tail, vehicles, saturated, band and confidence of the tail reader.

    Needs row_shares, far_row, camera_row, horizon and station_scale. A clear road claims
    nothing about the compound; the vehicle number is shown but never stored.
    """
    read = frames.withColumn("tail", tail_row(F.col("row_shares"))).withColumn(
        "vehicles",
        vehicles_at(F.col("tail"), F.col("camera_row"), F.col("horizon"), F.col("station_scale")),
    )
    queue = F.coalesce(F.col("vehicles") >= MIN_VEHICLES, F.lit(False))
    return read.withColumns(
        {
            "queue": queue,
            "saturated": queue & (F.col("tail") <= F.col("far_row")),
            "band": F.when(queue, "heavy"),
        }
    ).withColumn(
        "confidence",
        F.when(F.col("tail").isNull(), 0.9).when(~F.col("queue"), 0.5)
        .when(F.col("saturated"), 0.7).otherwise(0.9),
    )


def _drift(search: int):
    @F.arrow_udf(T.DoubleType())
    def drift(pixels: pa.Array, width: pa.Array, height: pa.Array, boundaries: pa.Array) -> pa.Array:
        found: list[float | None] = []
        known: dict[str, tuple[np.ndarray, ...]] = {}
        for image, w, h, lines in zip(_rows(pixels), width.to_pylist(), height.to_pylist(), boundaries.to_pylist(), strict=True):
            if len(image) != w * h:
                found.append(None)
                continue
            if (name := repr((w, h, lines))) not in known:
                kept = [(line["row"], x) for line in lines for x in line["xs"] if 0 <= line["row"] < h]
                rows, expected = np.array([r for r, _ in kept], int), np.array([x for _, x in kept], float)
                low = np.trunc(expected).astype(int) - search
                fits = (low >= 1) & (low + 2 * search + 1 < w)
                known[name] = rows[fits], expected[fits], low[fits]
            rows, expected, low = known[name]
            if not len(rows):
                found.append(float("inf"))
                continue
            strips = image.reshape(h, w)[rows[:, None], low[:, None] + np.arange(2 * search + 1)].astype(float)
            best = strips.argmax(axis=1)
            typical = np.partition(strips, strips.shape[1] // 2, axis=1)[:, strips.shape[1] // 2]
            painted = strips[np.arange(len(rows)), best] - typical >= 8
            offsets = np.sort(np.abs(low + best - expected)[painted])
            found.append(float(offsets[len(offsets) // 2]) if len(offsets) >= 8 else float("inf"))
        return pa.array(found, pa.float64())

    return drift


def calibration_drift(frames: DataFrame, geometries: DataFrame, search: int = 6) -> DataFrame:
    """Add drift: the upper median distance of painted lines from where they are expected.

    geometries(terminal, camera, width, height, boundaries array<struct<row, xs>>): per camera the image
    rows and the expected x of every line on them. Fewer than eight lines found gives infinity, because nothing
    was measured; a frame of another size, or of a camera without geometry, gives NULL.
    """
    known = geometries.select("terminal", "camera", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("boundaries").alias("_lines"))
    return (
        frames.join(known, ["terminal", "camera"], "left")
        .withColumn("drift", _drift(search)("pixels", F.coalesce("_w", F.lit(-1)), F.coalesce("_h", F.lit(1)), F.coalesce("_lines", F.array())))
        .drop("_w", "_h", "_lines")
    )


def _ready(pending: DataFrame, backgrounds: DataFrame, calibrations: DataFrame, params: Params, max_reads: int | None) -> DataFrame:
    """Frames with their background and calibration; of these the oldest max_reads, chosen on metadata."""
    timed = pending.withColumn("hour", F.hour(local_time(F.col("captured_at"), params.zone)))
    if max_reads is not None:
        able = timed.select(*BUCKET, "captured_at", "frame_id").join(backgrounds.select(*BUCKET), BUCKET, "left_semi").join(
            calibrations.select("terminal", "camera"), ["terminal", "camera"], "left_semi"
        )
        timed = timed.join(able.orderBy("captured_at", "frame_id").limit(max_reads).select("frame_id"), "frame_id", "left_semi")
    return timed.join(backgrounds, BUCKET).join(calibrations, ["terminal", "camera"])


def skipped_frames(pending: DataFrame, backgrounds: DataFrame, calibrations: DataFrame, params: Params) -> DataFrame:
    """Frames that can't be read yet: (frame_id, reason)."""
    timed = pending.select("terminal", "camera", "frame_id", F.hour(local_time(F.col("captured_at"), params.zone)).alias("hour"))
    cal = calibrations.select("terminal", "camera", F.lit(True).alias("_cal")).distinct()
    back = backgrounds.select(*BUCKET, F.lit(True).alias("_back")).distinct()
    reason = F.when(F.col("_cal").isNull(), "no calibration").when(F.col("_back").isNull(), "no background")
    return (
        timed.join(cal, ["terminal", "camera"], "left").join(back, BUCKET, "left")
        .select("frame_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    )


def read_lane_frames(pending: DataFrame, backgrounds: DataFrame, calibrations: DataFrame,
                     params: Params, max_reads: int | None = None) -> DataFrame:
    """Readings of unread frames that have a calibration and their hour's background.

    Frames without either write nothing and use up no quota (skipped_frames lists them): the cap, oldest
    first, counts those that have both. Bad light, a moved camera or a frame of another size than its
    background gives an unusable row. pending carries
    `drift`; calibrations(terminal, camera, lanes, covers_compound, lanes_before_capacity).
    """
    ready = _ready(pending, backgrounds, calibrations, params, max_reads)
    everywhere = F.flatten(F.transform("lanes", lambda x: x["positions"]))
    read = lane_reading(lane_shares(with_illumination(ready, everywhere)))
    sized = F.col("lit").isNotNull() & F.col("drift").isNotNull()
    steady = F.coalesce(F.col("drift") <= MAX_DRIFT, F.lit(False))
    sound = F.coalesce(F.col("lit"), F.lit(False)) & steady
    note = F.when(~sized, OTHER_SIZE).when(~F.col("lit"), "light differs from the reference").when(
        F.col("drift") == float("inf"), "no lane paint found"
    ).when(~steady, "camera may have moved")
    return read.select(
        "frame_id", F.lit(params.lane_version).alias("version"),
        F.when(sound, F.col("lanes_occupied")).alias("lanes_occupied"),
        (sound & F.col("reaches_last_lane")).alias("beyond"),
        F.when(sound, "clear").otherwise("obscured").alias("visibility"),
        F.when(sound, F.col("band")).alias("band"),
        F.when(sound, F.round(F.greatest(F.lit(0.5), 1 - F.col("drift") / (2 * MAX_DRIFT)), 3))
        .otherwise(F.lit(0.0)).alias("confidence"),
        (sound & F.col("band").isNotNull()).alias("usable"),
        note.alias("notes"), F.round("light_ratio", 3).alias("light_ratio"),
    )


def read_extent_frames(pending: DataFrame, backgrounds: DataFrame, calibrations: DataFrame,
                       params: Params, max_reads: int | None = None) -> DataFrame:
    """As read_lane_frames for a road camera.

    calibrations(terminal, camera, rows array<struct<row, positions>>, light_positions,
    far_row, camera_row, horizon, station_scale).
    """
    ready = _ready(pending, backgrounds, calibrations, params, max_reads)
    lit = with_illumination(ready, F.col("light_positions"))
    read = extent_reading(row_shares(lit))
    sound = F.coalesce(F.col("lit"), F.lit(False))
    return read.select(
        "frame_id", F.lit(params.extent_version).alias("version"),
        (sound & F.col("saturated")).alias("beyond"),
        F.when(sound, F.col("band")).alias("band"),
        F.when(sound, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        sound.alias("usable"),
        F.when(F.col("lit").isNull(), OTHER_SIZE).when(~sound, "light differs from the reference")
        .when(F.col("tail").isNull(), "road clear past the camera")
        .when(~F.col("queue"), "too few vehicles to tell")
        .when(F.col("saturated"), "queue runs past the top of frame")
        .otherwise("queue on the road").alias("notes"),
        F.when(sound, F.col("tail")).alias("tail"),
        F.when(sound, F.round("vehicles", 1)).alias("vehicles"),
        F.round("light_ratio", 3).alias("light_ratio"),
    )
