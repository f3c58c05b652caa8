"""Helpers the operators share: the shared folder, written tables and words at byte level."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, or the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: later steps neither
    compute them again nor depend on an executor that may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(*cols: Column) -> list[Column]:
    """128 bits that name a row by its content; equal rows share them."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def word_array(text: Column) -> Column:
    """The maximal runs without blanks; no text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


# Byte classes for numpy code over UTF-8 buffers.
_codes = np.arange(256)
NOT_BLANK = ~(((_codes >= 9) & (_codes <= 13)) | (_codes == 32))
LETTER_OR_DIGIT = (
    ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
    | (_codes >= 128)
)
_random = np.random.default_rng(20260801)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of concatenated texts, A-Z lowered, and the number of words of each.

    data: bytes; ends: where each text ends; word_bytes: which of the 256 bytes belong to words.
    Words never run from one text into the next. Work is one pass of array arithmetic, cut into
    pieces of whole texts so that scratch memory stays near 60 bytes for each of 1 M bytes (or of
    the longest text).
    """
    hashes, counts, first, begin = [], [], 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, begin + (1 << 20), "right")))
        stop = int(ends[last - 1])
        h, c = _word_hashes(data[begin:stop], ends[first:last] - begin, word_bytes)
        hashes.append(h)
        counts.append(c)
        first, begin = last, stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _word_hashes(data: np.ndarray, ends: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = word_bytes[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.append(inside[1:], False)
    after[edge[1:]] = False
    stops = np.flatnonzero(inside & ~after) + 1
    power, unpower = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    h = (sums[stops] - sums[starts]) * unpower[starts]
    h = mixed(h + (stops - starts).astype(np.uint64) * _BASE)
    reach = np.searchsorted(starts, ends, "left")
    return h, np.diff(reach, prepend=0)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value ends; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of at most so many text bytes (one row at least)."""
    for batch in batches:
        _, ends = string_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + most_bytes, "right")))
            yield batch.slice(first, last - first)
            first = last


def binary_array(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive pieces of data, ending where told, as a binary column."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
