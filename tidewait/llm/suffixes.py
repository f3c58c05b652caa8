"""Suffix-array dedup: repeated 100-byte strings by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import _power_tables, binary_array, mixed, pieces, row_key, string_bytes, written

GRAM = 24  # bytes of the strings by which repeats are brought together
SYMBOL = 25  # bytes of one symbol of the transforms; the match length is a multiple of it
FRAGMENT = 1 << 20  # entries of a fragment, on average
BUCKET = 4 << 20  # bytes merged in one task, on average
SHARD = 2 << 20  # bytes of one shard's transform
PIECE = 1 << 20  # bytes of text a task works on at a time
STRING = 80  # bytes a string of a hot gram takes in its bucket
SAMPLE = 64  # one document in so many at most tells which grams are hot
WITNESS = np.uint32(0xFFFFFFFF)
_POSITION = np.uint64(0xFFFFFFFF)
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashed:
    """Hashes of any byte range of a buffer from one running sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.unpower = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.power[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[begin + length] - self.sums[begin]) * self.unpower[begin])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.unpower[:n]) if n > 0 else np.zeros(0, np.uint64)


def _runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """The strings of `match` bytes inside the texts, in runs that share their least gram (the leftmost, at a tie).

    Which gram of a string is least depends on its bytes alone, so equal strings have it in one place. Returns the
    text, first string, number of strings and place of the gram for each run, and the grams' hashes.
    """
    none = np.zeros(0, np.int64)
    hashes = Hashed(data).all(GRAM)
    wide = match - GRAM + 1
    if len(hashes) < wide:
        return none, none, none, none, np.zeros(0, np.uint64)
    least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    valid = np.zeros(len(least) + 1, np.int64)
    long = ends - begins >= match
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - match + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64)
    place = (least[at] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1))
    first, count = at[new], np.diff(np.append(new, len(at)))
    return np.searchsorted(ends, first, "right"), first, count, place[new], hashes[place[new]]


# -- First cut: runs whose gram is found anywhere else --------------------------------------------------------

_SENT = ["fragment", "task", "piece", "keys", "which"]
_SENT_TYPE = "fragment long, task int, piece int, keys binary, which binary"


def _first_of_equal(batch: pa.RecordBatch, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of a batch that are the first, by order, of their text."""
    begins = np.concatenate([[0], ends[:-1]])
    raw = data.tobytes()
    digest = np.array([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(begins, ends, strict=True)], dtype="S8")
    order = np.lexsort((batch.column("k2").to_numpy(), batch.column("k1").to_numpy(), batch.column("ord").to_numpy()))
    _, first = np.unique(digest[order], return_index=True)
    return np.sort(order[first])


def _scattered(bits: int, match: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, "text", PIECE)):
            data, ends = string_bytes(batch.column("text"))
            if not len(data):
                continue
            begins = np.concatenate([[0], ends[:-1]])
            chosen = np.zeros(len(ends), bool)
            chosen[_first_of_equal(batch, data, ends)] = True
            doc, first, count, place, gram = _runs(data, np.where(chosen, begins, ends), ends, match)
            if not len(doc):
                continue
            order = np.argsort(gram)
            sorted_gram, which = gram[order], order.astype(np.uint32)
            new = np.ones(len(gram) + 1, bool)
            np.not_equal(sorted_gram[1:], sorted_gram[:-1], out=new[1:-1])
            alone = new[:-1] & new[1:]
            local = np.zeros(len(gram), np.uint8)
            local[which[~alone]] = 1
            which[~alone] = WITNESS
            sorted_gram, which = sorted_gram[new[:-1]], which[new[:-1]]
            fragment = (sorted_gram >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(which), np.int64)
            cuts = np.flatnonzero(np.diff(fragment, prepend=-1))
            cut_ends = np.append(cuts[1:], len(fragment)) * 4
            yield pa.record_batch(
                [
                    pa.array(fragment[cuts]), pa.array(np.full(len(cuts), task, np.int32)), pa.array(np.full(len(cuts), number, np.int32)),
                    binary_array((sorted_gram >> np.uint64(32 - bits)).astype(np.uint32), cut_ends), binary_array(which, cut_ends),
                ],
                _SENT,
            )
            docs, per_doc = np.unique(doc, return_counts=True)
            head = np.concatenate([
                batch.column("k1").to_numpy()[docs], batch.column("k2").to_numpy()[docs], per_doc.astype(np.int64),
            ])
            tail = np.concatenate([local, count.astype(np.uint8), (place - first).astype(np.uint8)])
            yield pa.record_batch(
                [
                    pa.array([-1 - task * (1 << 24) - number], pa.int64()), pa.array([task], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([head.tobytes()], pa.binary()), pa.array([tail.tobytes()], pa.binary()),
                ],
                _SENT,
            )

    return scatter


def _repeated(table: pa.Table) -> pa.Table:
    """Which entries of each piece have a key that is found elsewhere in this fragment."""
    table = table.combine_chunks()
    if table.column("fragment")[0].as_py() < 0:
        return table.select(_SENT)
    keys, ends = string_bytes(table.column("keys").combine_chunks())
    keys = keys.view(np.uint32)
    which = string_bytes(table.column("which").combine_chunks())[0].view(np.uint32)
    # Thirty bytes an entry: order and keys stay at 32 bits, and runs of equal keys are told by their neighbours.
    order = np.argsort(keys, kind="stable").astype(np.uint32)
    keys = keys[order]
    opens = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=opens[1:-1])
    again = ~(opens[:-1] & opens[1:])
    named = np.unique(keys[which[order] == WITNESS])
    low, high = np.searchsorted(keys, named, "left"), np.searchsorted(keys, named, "right")
    run = high - low
    again[np.repeat(low - (np.cumsum(run) - run), run) + np.arange(run.sum())] = True
    shared = np.empty(len(keys), bool)
    shared[order] = again
    shared &= which != WITNESS
    del keys, order, opens, again
    upto = np.concatenate([[0], np.cumsum(shared)])[ends // 4]
    nothing = binary_array(b"", np.zeros(len(table), np.int64))
    return pa.table([table.column("fragment"), table.column("task"), table.column("piece"), nothing, binary_array(which[shared], upto * 4)], _SENT)


def _marked_runs(table: pa.Table) -> pa.Table:
    """Per text its runs with a repeated gram: first strings, numbers of strings, gram places."""
    fragment = table.column("fragment").to_pylist()
    meta = next(k for k, f in enumerate(fragment) if f < 0)
    k1, k2, per_doc = np.frombuffer(table.column("keys")[meta].as_py(), np.int64).reshape(3, -1)
    local, count, place = np.frombuffer(table.column("which")[meta].as_py(), np.uint8).reshape(3, -1)
    hit = local.astype(bool)
    for k, f in enumerate(fragment):
        if f >= 0:
            hit[np.frombuffer(table.column("which")[k].as_py(), np.uint32)] = True
    doc = np.repeat(np.arange(len(k1)), per_doc)
    first = np.cumsum(count, dtype=np.int64) - count
    first -= np.repeat(first[np.cumsum(per_doc) - per_doc], per_doc)
    ends = np.cumsum(np.bincount(doc[hit], minlength=len(k1)))
    some = pa.array(np.flatnonzero(np.diff(ends, prepend=0)))
    return pa.table(
        [
            pa.array(k1), pa.array(k2), binary_array(first[hit].astype(np.uint32), ends * 4), binary_array(count[hit], ends), binary_array(place[hit], ends),
        ],
        ["k1", "k2", "firsts", "counts", "places"],
    ).take(some)


# -- Pieces of text, by gram, and their transforms --------------------------------------------------------------


_CUT = ["bucket", "ord", "k1", "k2", "first", "count", "digest", "gram", "piece"]
_CUT_TYPE = "bucket long, ord long, k1 long, k2 long, first long, count long, digest long, gram long, piece binary"


def _marked(batch: pa.RecordBatch, match: int) -> tuple[np.ndarray, ...]:
    """The text bytes of a batch, their hashes and the marked runs: text, begin, first string, number of strings, gram."""
    data, ends = string_bytes(batch.column("text"))
    flat, run_ends = string_bytes(batch.column("firsts"))
    first = flat.view(np.uint32).astype(np.int64)
    count = string_bytes(batch.column("counts"))[0].astype(np.int64)
    place = string_bytes(batch.column("places"))[0].astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(run_ends, prepend=0) // 4)
    begin = np.concatenate([[0], ends[:-1]])[doc] + first
    hashed = Hashed(data)
    return data, hashed, doc, begin, first, count, hashed.of(begin + place, GRAM)


def _weighed(match: int):
    """Gram, digest and number of strings of each piece."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            _, hashed, _, begin, _, count, gram = _marked(batch, match)
            if len(begin):
                digest = hashed.of(begin, count + match - 1)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(count)], ["gram", "digest", "count"])

    return weigh


def _leads(digest: np.ndarray, count: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of all equal pieces, by place, and the later ones."""
    order = np.lexsort((*reversed(place), count, digest))
    lead = np.ones(len(order), bool)
    lead[1:] = (digest[order][1:] != digest[order][:-1]) | (count[order][1:] != count[order][:-1])
    return order[lead], order[~lead]


def _cut(buckets: int, match: int, hot: np.ndarray, hot_buckets: int):
    """One row per different piece of a batch, in the bucket of its gram; a later equal piece has no bytes and no bucket.

    Pieces around a hot gram are cut to their strings, which go without bytes to one of the hot buckets, by the string's hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in pieces(batches, "text", PIECE):
            data, hashed, doc, begin, first, count, gram = _marked(batch, match)
            if not len(first):
                continue
            size = count + match - 1
            digest = hashed.of(begin, size)
            ordinal, k1, k2 = (batch.column(c).to_numpy()[doc] for c in ("ord", "k1", "k2"))
            kept, later = _leads(digest, count, ordinal, k1, k2, first)
            is_hot = np.isin(gram[kept], hot)
            split, kept = kept[is_hot], kept[~is_hot]
            bucket = np.concatenate([(gram[kept] % np.uint64(buckets)).astype(np.int64), np.full(len(later), -1 - task)])
            rows = np.concatenate([kept, later])
            width = np.concatenate([size[kept], np.zeros(len(later), np.int64)])
            upto = np.cumsum(width)
            bytes_at = np.repeat(begin[rows] - (upto - width), width) + np.arange(width.sum())
            yield pa.record_batch(
                [
                    pa.array(bucket), *(pa.array(x[rows]) for x in (ordinal, k1, k2, first, count, digest.view(np.int64), gram.view(np.int64))),
                    binary_array(data[bytes_at], upto),
                ],
                _CUT,
            )
            for k in range(0, len(split), PIECE // match):
                some = split[k : k + PIECE // match]
                own = np.repeat(some, count[some])
                at = np.arange(len(own)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                string, one = hashed.of(begin[own] + at, match), np.ones(len(own), np.int64)
                lead, again = _leads(string, one, ordinal[own], k1[own], k2[own], first[own] + at)
                bucket = np.concatenate([buckets + (string[lead] % np.uint64(hot_buckets)).astype(np.int64), np.full(len(again), -1 - task)])
                rows = np.concatenate([lead, again])
                yield pa.record_batch(
                    [
                        pa.array(bucket), *(pa.array(x[own][rows]) for x in (ordinal, k1, k2)), pa.array((first[own] + at)[rows]), pa.array(one[rows]),
                        pa.array(string[rows].view(np.int64)), pa.array(gram[own][rows].view(np.int64)),
                        binary_array(b"", np.zeros(len(rows), np.int64)),
                    ],
                    _CUT,
                )

    return cut


class Transform:
    """A Burrows-Wheeler transform over SYMBOL-byte symbols: the symbol before each suffix, suffixes in order.

    Suffixes go in steps of SYMBOL bytes, so every byte position starts one; the order is by as many symbols as
    the match has. ids name the suffixes; the empty ones, at the end of every chain of steps, have none (-1).
    """

    def __init__(self, before: np.ndarray, ids: np.ndarray):
        self.before, self.ids = before, ids

    @classmethod
    def of_shard(cls, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, base: int, depth: int) -> Transform:
        """symbols: rank (from 1) of the SYMBOL bytes at each position of consecutive pieces of `sizes` positions."""
        n = len(symbols)
        at = np.arange(n) - np.repeat(begins, sizes)
        rest = np.repeat(sizes, sizes) - at
        rank, step = symbols, 1
        while step < depth:  # prefix doubling, as far as the match is long
            nxt = np.zeros(n, np.int64)
            more = np.flatnonzero(rest > step * SYMBOL)
            nxt[more] = rank[more + step * SYMBOL]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + nxt, return_inverse=True)[1] + 1
            step *= 2
        order = np.argsort(rank, kind="stable")
        before = np.zeros(n, np.int64)
        inner = np.flatnonzero(at >= SYMBOL)
        before[inner] = symbols[inner - SYMBOL]
        last = np.flatnonzero(rest <= SYMBOL)  # before each empty suffix stands the last symbol of its chain
        return cls(
            np.concatenate([symbols[last], before[order]]).astype(np.int32),
            np.concatenate([np.full(len(last), -1), order + base]).astype(np.int32),
        )

    def merged(self, other: Transform, depth: int) -> tuple[Transform, np.ndarray]:
        """The transform of both, and the interval of suffixes with equal first `depth` symbols each is in.

        Iterative interleave refinement: in round h the two transforms are read in the interleave that is right for h
        symbols; a stable sort by the symbols read gives the interleave for h + 1. A place where the interval or the symbol
        changes begins an interval: its common prefix with the one before is h symbols.
        """
        n = len(self.ids) + len(other.ids)
        shift = np.int64(max(1, n).bit_length())
        mask = np.int64((1 << int(shift)) - 1)
        side = np.zeros(n, bool)
        side[len(self.ids) :] = True
        interval = np.zeros(n, np.int32)
        for _ in range(depth):
            key = self._interleaved(side, self.before, other.before).astype(np.int64)
            key <<= shift
            key |= np.arange(n)
            key.sort()  # places are different, so this order is the stable one
            symbol, source = (key >> shift).astype(np.int32), (key & mask).astype(np.int32)
            del key
            side, interval = side[source], interval[source]
            begins = np.zeros(n, bool)
            begins[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
            interval = np.cumsum(begins, dtype=np.int32)
        both = Transform(self._interleaved(side, self.before, other.before), self._interleaved(side, self.ids, other.ids))
        return both, interval

    @staticmethod
    def _interleaved(side: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty(len(side), np.int32)
        out[~side] = first
        out[side] = second
        return out


def repeated_strings(data: np.ndarray, sizes: np.ndarray, match: int) -> np.ndarray:
    """For pieces of bytes in order of their rank: which positions start a string of `match` bytes that also starts
    at an earlier position. One value for each of the sizes - match + 1 positions of each piece."""
    depth = match // SYMBOL
    positions = sizes - SYMBOL + 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    at = np.repeat(begins - (np.cumsum(positions) - positions), positions) + np.arange(positions.sum())
    symbols = np.unique(Hashed(data).of(at, SYMBOL), return_inverse=True)[1].astype(np.int64) + 1
    upto = np.cumsum(positions)
    cuts = [0]
    half = min(SHARD, max(1, int(upto[-1]) // 2))
    while cuts[-1] < len(sizes):
        so_far = int(upto[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, so_far + half, "right"))))
    shards = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        base = int(upto[a] - positions[a])
        part = positions[a:b]
        shards.append(Transform.of_shard(symbols[base : int(upto[b - 1])], np.cumsum(part) - part, part, base, depth))
    if len(shards) == 1:
        shards.append(Transform(np.zeros(0, np.int32), np.zeros(0, np.int32)))
    while len(shards) > 1:  # neighbours merge, so that transforms of one size meet
        pairs = [shards[k : k + 2] for k in range(0, len(shards), 2)]
        done = [pair[0].merged(pair[1], depth) if len(pair) == 2 else (pair[0], None) for pair in pairs]
        shards = [t for t, _ in done]
    ids, interval = shards[0].ids, done[0][1]
    whole = np.zeros(len(symbols), bool)
    starts = np.cumsum(positions) - positions
    windows = sizes - match + 1
    mine = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    whole[mine] = True
    ok = (ids >= 0) & whole[np.maximum(ids, 0)]
    ids, interval = ids[ok], interval[ok]
    later = np.zeros(len(symbols), bool)
    if len(ids):
        begin = np.flatnonzero(np.diff(interval, prepend=-1))
        earliest = np.minimum.reduceat(ids, begin)
        later[ids] = ids > np.repeat(earliest, np.diff(np.append(begin, len(ids))))
    return later[mine]


def _twice(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


_SPANS = ["k1", "k2", "begin", "end"]
_SPANS_TYPE = "k1 long, k2 long, begin long, end long"


def _merged(match: int, buckets: int):
    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ordinal, k1, k2, first, count, digest, gram = (table.column(c).to_numpy() for c in _CUT[1:8])
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table([table.column("k1"), table.column("k2"), pa.array(first), pa.array(first + count + match - 1)], _SPANS)
        kept, later = _leads(digest, count, ordinal, k1, k2, first)
        if bucket >= buckets:  # single strings: equal ones are all that repeats
            kept = kept[:0]
        # A piece repeats nothing inside itself; one that is alone with its gram repeats nothing at all.
        kept = kept[_twice(gram[kept])]
        kept = kept[np.lexsort((first[kept], k2[kept], k1[kept], ordinal[kept]))]
        data, ends = string_bytes(table.column("piece").take(pa.array(kept)).combine_chunks())
        hit = repeated_strings(data, np.diff(ends, prepend=0), match) if len(kept) else np.zeros(0, bool)
        piece = np.repeat(np.arange(len(kept)), count[kept])
        at = np.arange(len(hit)) - np.repeat(np.cumsum(count[kept]) - count[kept], count[kept])
        edge = np.flatnonzero(np.diff(np.where(hit, piece, -1), prepend=-1, append=-1) != 0)
        begin = edge[:-1][hit[edge[:-1]]] if len(edge) else edge
        last = edge[1:][hit[edge[:-1]]] - 1 if len(edge) else edge
        row = kept[piece[begin]]
        rows = np.concatenate([row, later])
        return pa.table(
            [
                pa.array(k1[rows]), pa.array(k2[rows]),
                pa.array(np.concatenate([first[row] + at[begin], first[later]])),
                pa.array(np.concatenate([first[row] + at[last] + match, first[later] + count[later] + match - 1])),
            ],
            _SPANS,
        )

    return merge


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, ends = string_bytes(batch.column("text"))
        begins = np.concatenate([[0], ends[:-1]])
        spans = batch.column("spans")
        number = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.repeat(begins, number)
        flat = spans.flatten()
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, base + flat.field("begin").to_numpy(zero_copy_only=False), 1)
        np.add.at(change, base + flat.field("end").to_numpy(zero_copy_only=False), -1)
        gone = np.cumsum(change[:-1]) > 0
        texts, removed, runs = [], [], []
        for a, b, n in zip(begins.tolist(), ends.tolist(), number.tolist(), strict=True):
            mask = gone[a:b]
            texts.append(data[a:b][~mask].tobytes() if n else data[a:b].tobytes())
            removed.append(b - a - len(texts[-1]))
            runs.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if removed[-1] else 0)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(ends - begins), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(texts, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _order(doc_id: Column) -> Column:
    """Ids as whole numbers, null before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long"))


def drop_repeats(docs: DataFrame, match: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left of the UTF-8 bytes).

    A byte goes if some string of `match` bytes covers it that also starts earlier: in a row of smaller doc_id, or
    earlier in the same text. Matches never run across texts and are judged on the input. match must be a multiple of
    25; ids are whole numbers.

    Null text counts as empty; texts under `match` bytes stay whole. Null ids come before all others; different
    texts of one id follow an order of their hashes; rows equal in id and text are one document. Other
    columns are not read, whatever their names. An empty table gives an empty result.

    Plan: texts equal to an earlier one go whole and take no further part. Strings are brought together by the least
    24-byte gram inside them, which equal strings share: fragments of the gram order tell which grams are found twice
    (a gram that is everywhere comes once from each batch), and only text around those is cut into pieces and sent
    to the bucket of its gram, equal pieces of a batch once. A gram with so many different pieces that they would fill a bucket (counted on
    one document in SAMPLE) is hot: its pieces are cut to their strings, which are spread by their own hash, so equal strings still
    meet, once from each batch. Each bucket of the others, a bounded share of the text, is indexed by
    shards: their Burrows-Wheeler transforms are merged by interleave refinement, whose final intervals are the repeated strings.
    """
    if match % SYMBOL or match < GRAM + 1:
        raise ValueError(f"match must be a multiple of {SYMBOL}")
    rows = docs.select(F.col(id_col).alias("doc_id"), _order(F.col(id_col)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *row_key(F.col("ord"), F.col("text")))
    narrow = written(
        rows.select("ord", "k1", "k2", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")),
        "suffix-rows",
    ).filter(F.col("size") >= match)
    firsts = written(narrow.groupBy("t1", "t2").agg(F.min(F.struct("ord", "k1", "k2")).alias("f")).select("t1", "t2", "f.k1", "f.k2"), "suffix-firsts")
    whole = narrow.join(firsts.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "k1", "k2", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")
    )
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(0, (-(-total // (40 * FRAGMENT)) - 1).bit_length())
    marked = (
        rows.select("ord", "k1", "k2", "text").mapInArrow(_scattered(bits, match), _SENT_TYPE)
        .groupBy("fragment").applyInArrow(_repeated, _SENT_TYPE)
        .groupBy("task", "piece").applyInArrow(_marked_runs, "k1 long, k2 long, firsts binary, counts binary, places binary")
        .join(firsts.select("k1", "k2"), ["k1", "k2"], "left_semi")
        .dropDuplicates(["k1", "k2"])
    )
    marked = written(marked, "suffix-runs")
    runs = marked.agg(F.coalesce(F.sum(F.length("counts")), F.lit(0))).first()[0]
    buckets = max(1, -(-runs * (match + 40) // BUCKET))
    # A gram whose different pieces fill a bucket by themselves is hot. Which are flagged changes no result.
    one_in = max(1, min(SAMPLE, BUCKET // ((match + 40) * 200)))
    some = F.pmod("k1", F.lit(one_in)) == 0
    sample = rows.filter(some).join(marked.filter(some), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "firsts", "counts", "places")
    weights = sample.mapInArrow(_weighed(match), "gram long, digest long, count long").distinct().groupBy("gram").agg(
        F.count("*").alias("n"), F.sum("count").alias("strings")
    )
    weights = weights.filter(F.col("n") > BUCKET / ((match + 40) * one_in)).toArrow()
    hot = np.sort(weights.column("gram").to_numpy().view(np.uint64))
    hot_buckets = max(1, -(-sum(weights.column("strings").to_pylist()) * one_in * STRING // BUCKET))
    # Texts are dealt by row key once: both joins take the same columns of them, in one plan, so the second reads the first's shuffle.
    keyed = rows.select("doc_id", "text", "k1", "k2")
    cut = (
        keyed.join(marked, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).withColumn("ord", _order(F.col("doc_id")))
        .select("ord", "k1", "k2", "text", "firsts", "counts", "places")
        .mapInArrow(_cut(buckets, match, hot, hot_buckets), _CUT_TYPE)
    )
    spans = cut.groupBy("bucket").applyInArrow(_merged(match, buckets), _SPANS_TYPE).unionByName(whole)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
        .mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    )
