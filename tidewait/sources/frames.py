"""Fetched image files turned into frame rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewait.functions.clock import local_date, local_time
from tidewait.params import Params


def image_type(content: Column) -> Column:
    """File type by its first bytes; RIFF is an image only when it says WEBP."""
    head = F.hex(F.substring(content, 1, 12))
    # Image signatures.
    return (
        F.when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def _number(content: Column, first: Column | int, count: int, little: bool = False) -> Column:
    """A whole number of so many bytes at a place (the first is 1); NULL where the file ends before it."""
    first = F.lit(first) if isinstance(first, int) else first
    raw = F.hex(F.substring(content, first, F.lit(count)))
    if little:
        raw = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(count))])
    return F.when(F.length(content) >= first + count - 1, F.conv(raw, 16, 10).cast("long"))


# Markers without a length, and those that open a frame with its size.
BARE_MARKERS = (0x01, *range(0xD0, 0xD9))
FRAME_MARKERS = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
SCAN_MARKERS = (0xD9, 0xDA)
FIRST_STEPS = 64


def _jpeg_size(content: Column) -> Column:
    """(width, height) of the first frame segment, found by walking from segment to segment by their lengths.

    One step reads one marker. Most files need a few; the walk over as many steps as the file could hold is
    taken only where the first steps did not end it."""
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))

    def stop(width: Column | None = None, height: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(none.alias("at"), (none if width is None else width).alias("width"), (none if height is None else height).alias("height"))

    def go(at: Column) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(at.alias("at"), none.alias("width"), none.alias("height"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"].cast("int")
        lead, marker, length = _number(content, at, 1), _number(content, at + 1, 1), _number(content, at + 2, 2)
        read = (
            F.when(marker.isNull() | (lead != 0xFF), stop())
            .when(marker == 0xFF, go(state["at"] + 1))
            .when(marker.isin(*BARE_MARKERS), go(state["at"] + 2))
            .when(marker.isin(*FRAME_MARKERS), stop(_number(content, at + 7, 2), _number(content, at + 5, 2)))
            .when(marker.isin(*SCAN_MARKERS) | length.isNull() | (length < 2), stop())
            .otherwise(go(state["at"] + 2 + length))
        )
        return F.when(state["at"].isNull(), state).otherwise(read)

    soon = F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_STEPS)), start, step)
    rest = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(content)))
    return F.get(F.transform(F.array(soon), lambda s: F.when(s["at"].isNull(), s).otherwise(F.aggregate(rest, s, step))), F.lit(0))


def _webp_size(content: Column) -> Column:
    """The size in the first chunk: lossy, lossless or extended."""
    bits, canvas, lossy = _number(content, 22, 4, True), lambda at: _number(content, at, 3, True) + 1, lambda at: _number(content, at, 2, True)
    chunk = F.substring(content, 13, 4).cast("string")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    fourteen = lambda n: n.bitwiseAND(0x3FFF)
    return (
        F.when((chunk == "VP8 ") & (F.hex(F.substring(content, 24, 3)) == "9D012A"), size(fourteen(lossy(27)), fourteen(lossy(29))))
        .when((chunk == "VP8L") & (_number(content, 21, 1) == 0x2F), size(fourteen(bits) + 1, fourteen(F.shiftright(bits, 14)) + 1))
        .when(chunk == "VP8X", size(canvas(25), canvas(28)))
    )


def header_size(content: Column, kind: Column) -> Column:
    """(width, height) as the file itself states them, without decoding it; both NULL where it ends before it does."""
    jpeg = _jpeg_size(content)
    read = (
        F.when(kind == "png", F.struct(_number(content, 17, 4).alias("width"), _number(content, 21, 4).alias("height")))
        .when(kind == "gif", F.struct(_number(content, 7, 2, True).alias("width"), _number(content, 9, 2, True).alias("height")))
        .when(kind == "jpg", F.transform(F.array(jpeg), lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height")))[0])
        .when(kind == "webp", _webp_size(content))
    )
    return F.get(F.filter(F.array(read), lambda s: s["width"].isNotNull() & s["height"].isNotNull()), F.lit(0))


def _sized(fetched: DataFrame) -> DataFrame:
    typed = fetched.withColumn("_type", image_type(F.col("content")))
    return typed.withColumn("_size", header_size(F.col("content"), F.col("_type")))


def size_errors(fetched: DataFrame) -> DataFrame:
    """One error row (terminal, camera, captured_at, type, error) for every image that does not state its size: cut short, or
    no frame before its pixels. Such a frame is stored all the same, its size unknown."""
    bad = _sized(fetched).filter(F.col("_type").isNotNull() & F.col("_size").isNull())
    return bad.select("terminal", "camera", "captured_at", F.col("_type").alias("type"), F.lit("image does not state its size").alias("error"))


def ingest_frames(fetched: DataFrame, params: Params) -> DataFrame:
    """Frame rows from fetched(terminal, camera, captured_at, content, content_type, error).

    A missing, empty or non-image body is an `error` row and never an exception.
    """
    kind = F.col("_type")
    empty = F.col("content").isNull() | (F.length("content") == 0)
    problem = F.when(empty, F.coalesce("error", F.lit("empty response"))).when(
        kind.isNull(),
        F.concat(
            F.lit("response was not an image (content-type="),
            F.coalesce("content_type", F.lit("unknown")), F.lit(")"),
        ),
    )
    here = local_time(F.col("captured_at"), params.zone)
    stem = F.when(F.col("camera") == "main", F.col("terminal")).otherwise(
        F.concat_ws("_", "terminal", "camera")
    )
    path = F.concat(
        stem, F.date_format(here, "/yyyy/MM/dd/"), stem, F.date_format(here, "'_'yyyyMMdd'T'HHmmss"),
        F.lit("."), kind,
    )
    ok = problem.isNull()
    return _sized(fetched).select(
        *[c for c in fetched.columns if c not in ("content", "content_type", "error")],
        local_date(F.col("captured_at"), params.zone).alias("service_date"),
        F.when(ok, path).alias("path"),
        F.when(ok, F.sha2("content", 256)).alias("sha256"),
        F.when(ok, F.length("content")).alias("bytes"),
        F.when(ok, F.col("_size.width").cast("int")).alias("width"), F.when(ok, F.col("_size.height").cast("int")).alias("height"),
        F.when(ok, "ok").otherwise("error").alias("status"), problem.alias("error"),
    )


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw bytes of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
