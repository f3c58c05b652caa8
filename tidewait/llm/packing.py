"""Token-ID output: best-fit-decreasing packing into fixed-length id matrices."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import pieces

BLOCK_TOKENS = 1 << 21  # tokens packed together; bounds a task's memory


class CapacityTree:
    """Counts of bins by free room, in a segment tree: the least room that is enough is found in log time."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, which: int) -> None:
        self.bins.setdefault(room, []).append(which)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the smallest room >= least, or None."""
        k = least + self.leaves
        while self.count[k] == 0:
            while k & 1:  # a right child: what follows starts beside its parent
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k *= 2
            if self.count[k] == 0:
                k += 1
        room = k - self.leaves
        self._change(room, -1)
        return room, self.bins[room].pop()

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Pieces by bin: longest first, each into the bin that it leaves the least room in."""
    tree, bins = CapacityTree(room), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        got = tree.take(length)
        if got is None:
            left, which = room, len(bins)
            bins.append([])
        else:
            left, which = got
        bins[which].append(k)
        tree.add(left - length, which)
    return bins


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _packer(vocabulary, pattern: str, length: int, pad: int, dtype: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary.value, pattern)
        task, block = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        owners: list[tuple[object, int]] = []
        held = 0
        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = encoding.encode_to_numpy(text or "", disallowed_special=()).astype(dtype)
                for part in range(max(1, -(-len(tokens) // length))):
                    parts.append(tokens[part * length : (part + 1) * length])
                    owners.append((doc_id, part))
                    held += len(parts[-1])
                    if held >= BLOCK_TOKENS:
                        yield _packed(parts, owners, task, block, length, pad, dtype, batch.schema.field("doc_id").type)
                        parts, owners, held, block = [], [], 0, block + 1
        if parts:
            yield _packed(parts, owners, task, block, length, pad, dtype, batch.schema.field("doc_id").type)

    return pack


def _packed(parts, owners, task, block, length, pad, dtype, id_type) -> pa.RecordBatch:
    bins = best_fit_decreasing(np.array([len(p) for p in parts]), length)
    ids = np.full((len(bins), length), pad, dtype)
    ends, docs, orders = [], [], []
    for row, members in zip(ids, bins, strict=True):
        end = [0]
        for k in members:
            row[end[-1] : end[-1] + len(parts[k])] = parts[k]
            end.append(end[-1] + len(parts[k]))
        ends.append(end)
        docs.append([owners[k][0] for k in members])
        orders.append([owners[k][1] for k in members])
    return pa.record_batch(
        [
            pa.array([task] * len(bins), pa.int32()), pa.array([block] * len(bins), pa.int32()), pa.array(np.arange(len(bins), dtype=np.int32)),
            pa.array([end[-1] for end in ends], pa.int32()), pa.array(docs, pa.list_(id_type)), pa.array(orders, pa.list_(pa.int32())),
            pa.array(ends, pa.list_(pa.int32())), pa.array([row.tobytes() for row in ids], pa.binary()),
        ],
        ["task", "block", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", "ids"],
    )


def pack_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, length: int = 2048, pad: int = 50256, dtype: str = "<u2",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per packed sequence: task, block, row, n_tokens, doc_ids, parts, cu_seqlens, ids, resets.

    ids is one row of the id matrix: `length` little-endian numbers of dtype, padded at the end. cu_seqlens are the
    cumulative segment lengths, 0 first: segment k is part parts[k] of document doc_ids[k]. resets are the places
    of the row where positions begin at 0 again: where a segment of some tokens begins, and where padding does. Texts longer than a row are cut into parts of `length` tokens and
    a rest; the parts in order give every document back byte for byte.

    Null or empty text: one segment of no tokens, so that every row of the input is found in the output. Repeated rows
    and rows of one id are packed each by itself. Other columns are not read. An empty table gives no row.

    ranks_path: a byte-level vocabulary of base64 pieces and ranks, read on the driver and broadcast (its size does
    not depend on the data: about 1 MB for 50,000 pieces). dtype must hold the vocabulary and pad, else ValueError.

    Plan: one pass without a shuffle. A task packs 2**21 tokens at a time, so memory is bounded, hot sources and
    long texts make no difference, and a lost task repeats alone; at most the last bins of a block stay part empty.
    """
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    highest = max((int(line.split()[1]) for line in ranks.splitlines()), default=0)
    if pad < 0 or max(highest, pad) > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {highest} and pad {pad} do not fit {dtype}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = rows.mapInArrow(
        _packer(vocabulary, pattern, length, pad, dtype),
        f"task int, block int, row int, n_tokens int, doc_ids array<{kind}>, parts array<int>, cu_seqlens array<int>, ids binary",
    )
    return packed.withColumn("resets", F.array_distinct(F.filter("cu_seqlens", lambda at: at < length)))


def write_packed(packed: DataFrame, path: str) -> None:
    """Id matrices as Parquet: rows in the order they were packed, ids as fixed-length binary values."""
    packed.write.option("parquet.enable.dictionary", "false").parquet(path)


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of one row: they restart at 0 with every segment, and once more where padding begins."""
    starts = np.repeat(cu_seqlens, np.diff([*cu_seqlens, length]))
    return np.arange(length) - starts


def segments(ids: bytes, cu_seqlens: list[int], dtype: str = "<u2") -> list[np.ndarray]:
    row = np.frombuffer(ids, dtype)
    return [row[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)]


def decoder(ranks_path: str, pattern: str) -> Callable[[np.ndarray], bytes]:
    with open(ranks_path, "rb") as file:
        encoding = _encoding(file.read(), pattern)
    return lambda tokens: encoding.decode_bytes(tokens.tolist())
