"""What the exact vector searches share: integer vectors, classes of equal ones, and exact products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import written

LEAST, MOST = -(2**63), 2**63 - 1
CHUNK = 256


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, table: str, **more: Column) -> DataFrame:
    """Written rows (row, id, v, more): v is floor(scale * x) of every component, ends of the long range where it is passed.

    Rows whose vector is null or has a null or non-finite component are left out. `row` tells rows of one id apart."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(v.isNotNull() & ~bad)
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"), *[c.alias(n) for n, c in more.items()]), table)


def folded(rows: DataFrame, keys: list[str], keep: int, table: str) -> DataFrame:
    """Rows of equal vector and keys as one written class: (class, v, keys, tie, members).

    members are its `keep` first rows (id, null last, then row): a search for no more than so many rows can return
    no others. tie is the first id, the last number for none. Copies are cut before the shuffle."""
    order = Window.partitionBy("v", *keys).orderBy(F.col("id").asc_nulls_last(), "row")
    first = rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= keep)
    classes = first.groupBy("v", *keys).agg(F.array_sort(F.collect_list(F.struct("_at", "id", "row"))).alias("members"))
    tie = F.coalesce(F.col("members")[0]["id"], F.lit(MOST))
    return written(classes.select(F.monotonically_increasing_id().alias("class"), "v", *keys, tie.alias("tie"), "members"), table)


def first_members(found: DataFrame, classes: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """(keys, best): the first `keep` rows, (rank, id, row, score), of the classes found for each key, by score, then id."""
    rows = found.join(classes.select("class", "members"), "class").select(*keys, "score", F.explode("members").alias("m"))
    rows = rows.select(*keys, "score", "m.id", "m.row")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("best"))


def blocks_of(n_rows: int, most: int) -> int:
    return max(1, -(-n_rows // most))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of longs as a matrix of this width; what a shorter list lacks is 0."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if np.all(lengths == width):
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a with the rows of b, exact; beyond a long its nearest end.

    Floating point serves as long as every partial sum is a whole number below 2**53; then 64-bit integers, then any."""
    reach = float(np.abs(a.astype(float)).sum(axis=1).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if reach < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if reach < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def best(scores: np.ndarray, tie: np.ndarray, most: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `most` highest allowed scores of every row, ties to the smaller tie, then the earlier column."""
    shown = scores if allowed is None else np.where(allowed, scores, LEAST)
    if scores.shape[1] > most:
        cut = np.partition(shown, scores.shape[1] - most, axis=1)[:, -most]
        wanted = shown >= cut[:, None]
    else:
        wanted = np.ones(scores.shape, bool)
    if allowed is not None:
        wanted &= allowed
    r, c = np.nonzero(wanted)
    order = np.lexsort((c, tie[c], ~scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
    return r[rank < most], c[rank < most]
