"""N-gram Jaccard join by vertical partitioning of the n-gram order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import NOT_BLANK, binary_array, mixed, pieces, row_key, string_bytes, word_hashes, written
from tidewait.llm.components import components

GRAM = 5
LEAST, OF = 80, 100  # similarity of 0.8 as a fraction of whole numbers
FRAGMENT = 1 << 21  # n-grams in a fragment, on average: bounds a task's memory; changes no result
EXPAND = 1 << 20  # pairs or look-ups laid out at a time in a task; changes no result
FEW = 5  # sets of one n-gram that are paired at once; changes no result
HUBS = 4  # sets of one n-gram that all others are paired with at once; changes no result
PARTNERS = 3  # candidates a set keeps of the first two rounds', whatever the number of fragments; changes no result
DOUBT = 4  # n-grams not in common that are added to each pair's, so that few n-grams seen tell little; changes no result
SKETCH = 4, 1 << 15  # bits of a set's sketch for each of its n-grams, rounded up to a power of two, and at most; changes no result
PIECE = 4 << 20  # bytes of text a task works on at a time; changes no result
SMALL = 1 << 20  # documents left whose keys (16 MB) go to the texts; more of them, and the texts are shuffled
WITNESS = np.uint32(0xFFFFFFFF)
_STEPS = np.random.default_rng(5).integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _needed(n):
    """Least intersection of a set of n with any set it links to."""
    return -(-n * LEAST // OF)


def gram_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; with fewer words the whole sequence is one n-gram."""
    h, counts = word_hashes(data, ends, NOT_BLANK)
    rolled = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        rolled += h[k : len(h) - GRAM + 1 + k] * _STEPS[k] if len(rolled) else 0
    rolled = mixed(rolled)
    found, begin = [], 0
    for n in counts.tolist():
        if n >= GRAM:
            grams = np.sort(rolled[begin : begin + n - GRAM + 1])
            keep = np.ones(len(grams), bool)
            np.not_equal(grams[1:], grams[:-1], out=keep[1:])
            found.append(grams[keep])
        elif n:
            found.append(mixed((h[begin : begin + n] * _STEPS[:n]).sum(keepdims=True) ^ np.uint64(n)))
        else:
            found.append(np.zeros(0, np.uint64))
        begin += n
    return found


def _signature(grams: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        sets = gram_sets(*string_bytes(batch.column("text")))
        yield pa.record_batch(
            [
                batch.column("doc_id"), batch.column("k1"), batch.column("k2"),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.int64()),
            ],
            ["doc_id", "k1", "k2", "n", "sig"],
        )


def _packed(values: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, lowest first, which the shuffle's compression can shorten."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.uint32)


# -- First cut: which sets share enough n-grams with any other set at all --------------------------------------


def _scattered(bits: int):
    """One row per (piece of a task's input, fragment): 32 bits of each n-gram and which set of the piece it is of.

    A set that repeats in the piece is sent once. An n-gram of several sets of the piece is known to be
    shared: it is counted here and sent once, as a witness for other pieces; so one that is everywhere comes
    once from each piece, not from each document.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, "text", PIECE)):
            sets: dict[int, np.ndarray] = {}
            for grams in gram_sets(*string_bytes(batch.column("text"))):
                if len(grams):
                    sets.setdefault(_signature(grams), grams)
            if not sets:
                continue
            sizes = np.array([len(g) for g in sets.values()], np.int64)
            grams = np.concatenate(list(sets.values()))
            which = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            order = np.argsort(grams)
            grams, which = grams[order], which[order]
            new = np.ones(len(grams) + 1, bool)
            np.not_equal(grams[1:], grams[:-1], out=new[1:-1])
            alone = new[:-1] & new[1:]
            local = np.bincount(which[~alone], minlength=len(sizes))
            which[~alone] = WITNESS
            grams, which = grams[new[:-1]], which[new[:-1]]
            fragment = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            keys = (grams >> np.uint64(32 - bits)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(fragment, prepend=-1))
            stops = np.append(cuts[1:], len(fragment))
            width = 2 if len(sizes) < 0xFFFF else 4
            gaps = [_packed(np.diff(keys[a:b], prepend=np.uint32(0)), 4) for a, b in zip(cuts, stops, strict=True)]
            sent = [_packed(which[a:b], width) for a, b in zip(cuts, stops, strict=True)]
            meta = np.concatenate([np.fromiter(sets, np.int64, len(sets)), sizes, local.astype(np.int64)])
            rows = len(cuts)
            yield pa.record_batch(
                [
                    pa.array(fragment[cuts]), pa.array(np.full(rows, task, np.int32)), pa.array(np.full(rows, number, np.int32)),
                    pa.array(np.full(rows, len(sizes), np.int32)), pa.array(gaps, pa.binary()), pa.array(sent, pa.binary()),
                ],
                _SCATTERED,
            )
            yield pa.record_batch(
                [
                    pa.array([-1 - task * (1 << 24) - number], pa.int64()), pa.array([task], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([len(sizes)], pa.int32()), pa.array([meta.tobytes()], pa.binary()), pa.array([b""], pa.binary()),
                ],
                _SCATTERED,
            )

    return scatter


_SCATTERED = ["fragment", "task", "piece", "sets", "keys", "which"]


def _shared(table: pa.Table) -> pa.Table:
    """For each piece, which of its sets have n-grams in this fragment that some other set has too, and how many; a row per
    piece that has any, as long as what it found, so the rows grow with the n-grams and not with pieces times fragments."""
    table = table.combine_chunks()
    if table.column("fragment")[0].as_py() < 0:
        return pa.table([table.column("task"), table.column("piece"), pa.array([True] * len(table)), table.column("keys")], _COUNTED)
    sets = table.column("sets").to_numpy().astype(np.int64)
    first = np.cumsum(sets) - sets
    entries = []  # the n-gram's key above, its set (or WITNESS) below
    for gaps, sent, n, base in zip(table.column("keys"), table.column("which"), sets.tolist(), first.tolist(), strict=True):
        which = _unpacked(sent.as_buffer(), 2 if n < 0xFFFF else 4)
        entry = np.cumsum(_unpacked(gaps.as_buffer(), 4), dtype=np.uint32).astype(np.uint64) << np.uint64(32)
        entry |= np.where(which == (0xFFFF if n < 0xFFFF else WITNESS), WITNESS, which + np.uint32(base))
        entries.append(entry)
    entries = np.concatenate(entries)
    entries.sort()
    which = entries.astype(np.uint32)
    entries >>= np.uint64(32)
    twin = np.zeros(len(which) + 1, bool)
    np.equal(entries[1:], entries[:-1], out=twin[1:-1])
    # A witness sorts last in its run, but several pieces may send one: any run of two is shared, and so is a witness alone.
    hit = (twin[1:] | twin[:-1]) & (which != WITNESS)
    counts = np.bincount(which[hit], minlength=int(sets.sum())).astype(np.uint32)
    found = np.flatnonzero(counts)
    cuts = np.searchsorted(found, np.append(first, sets.sum()))
    per_piece = np.diff(cuts)
    rows = np.flatnonzero(per_piece)
    local = (found - np.repeat(first, per_piece)).astype(np.uint32)
    data = np.stack([local, counts[found]], axis=1)
    sent = pa.array(rows)
    return pa.table(
        [table.column("task").take(sent), table.column("piece").take(sent), pa.array([False] * len(rows), pa.bool_()), binary_array(data, cuts[1:][rows] * 8)],
        _COUNTED,
    )


_COUNTED = ["task", "piece", "meta", "data"]


def _survivors(table: pa.Table) -> pa.Table:
    total, sig, size = None, None, None
    found = []
    for meta, data in zip(table.column("meta").to_pylist(), table.column("data").to_pylist(), strict=True):
        if meta:
            sig, size, total = np.frombuffer(data, np.int64).reshape(3, -1).copy()
        else:
            found.append(np.frombuffer(data, np.uint32).reshape(-1, 2))
    for which, count in (part.T for part in found):
        total[which] += count
    return pa.table([pa.array(sig[total >= _needed(size)])], ["sig"])


# -- Fragments of the sets that are left ----------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, once in a piece."""
    for batch in pieces(batches, "text", PIECE):
        sets = {}
        for grams in gram_sets(*string_bytes(batch.column("text"))):
            if len(grams):
                sets.setdefault(_signature(grams), grams)
        if sets:
            ends = np.cumsum([0, *(len(g) for g in sets.values())]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(sets.values())).view(np.int64)))
            yield pa.record_batch([pa.array(np.fromiter(sets, np.int64, len(sets))), grams], ["sig", "grams"])


def _cut(bits: int):
    """One row per (set, fragment): its n-grams there and how many of them, rarest first, must be looked up.

    Of the n-grams of a set, all but needed may be missing in a set it links to. The look-ups of all its fragments together
    are one more than that, so at least one of them finds every partner.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, upto = batch.column("sig").to_numpy(), np.cumsum(pc.list_value_length(batch.column("grams")).to_numpy())
            first = 0
            while first < len(sig):
                begin = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, begin + PIECE // 8, "right")))
                yield _cut_sets(sig[first:last], np.diff(upto[first:last], prepend=begin), batch.column("grams")[first:last], bits)
                first = last

    return cut


def _cut_sets(sig: np.ndarray, sizes: np.ndarray, lists: pa.ListArray, bits: int) -> pa.RecordBatch:
    return _cut_grams(sig, sizes, sizes, lists.flatten().to_numpy().view(np.uint64), bits)[0]


def _cut_grams(sig: np.ndarray, sizes: np.ndarray, have: np.ndarray, grams: np.ndarray, bits: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows, and of which set each is. have: how many n-grams of each set of the given size are among these, in order."""
    owner = np.repeat(np.arange(len(sizes)), have)
    fragment = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(fragment, prepend=-1) != 0))
    ends = np.append(cuts[1:], len(grams))
    rows, of = ends - cuts, owner[cuts]
    probes = np.zeros(len(sizes), np.int64)
    first = np.searchsorted(of, np.arange(len(sizes) + 1))
    for k, (n, m) in enumerate(zip(sizes.tolist(), have.tolist(), strict=True)):
        most, q, parts = m - _needed(n) + 1, 0, rows[first[k] : first[k + 1]]
        while (lacking := most - int(np.minimum(parts, q).sum())) > 0:
            q += -(-lacking // len(parts))
        probes[k] = q
    batch = pa.record_batch(
        [
            pa.array(sig[of]), pa.array(sizes[of]), pa.array(fragment[cuts]), pa.array(np.minimum(probes[of], rows)),
            binary_array(grams, ends * 8),
        ],
        ["sig", "n", "fragment", "probes", "grams"],
    )
    return batch, of


def _outside(segments: pa.Table, known: pa.Table) -> pa.Table:
    """Of each set in this fragment the n-grams that a set of another component has too: only these can be common to sets
    that are still to be linked."""
    if not len(segments) or not len(known):
        return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.binary())], ["sig", "n", "root", "grams"])
    f = _Fragment(segments, known)
    order = np.lexsort((f.label[f.owner], f.grams))
    grams, label = f.grams[order], f.label[f.owner[order]]
    begin = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0)
    last = np.append(begin[1:], len(grams)) - 1
    several = np.repeat(label[begin] != label[last], last - begin + 1)
    kept = order[several]
    kept = kept[np.lexsort((f.grams[kept], f.owner[kept]))]
    count = np.bincount(f.owner[kept], minlength=len(f.sig))
    sent = np.flatnonzero(count)
    return pa.table(
        [pa.array(f.sig[sent]), pa.array(f.size[sent]), pa.array(f.label[sent]), binary_array(f.grams[kept], np.cumsum(count[sent]) * 8)],
        ["sig", "n", "root", "grams"],
    )


def _sketches(have: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, bits that tell of how many of its n-grams the hash ends so, odd or even, as 64-bit words end to end; and
    where the words of each set end. The bits in which two sketches differ are at most the n-grams that only one of the sets has."""
    wide = np.minimum(SKETCH[1], np.maximum(64, 1 << np.ceil(np.log2(SKETCH[0] * np.maximum(have, 1))).astype(np.int64)))
    ends = np.cumsum(wide // 64)
    at = np.repeat((ends * 64 - wide), have) + (grams & np.repeat(wide - 1, have).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(wide.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), ends


def _cut_open(bits: int):
    """As _cut, of what each set has in common with other components; each row also has the set's component, the number of
    those n-grams and their sketch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            have = batch.column("have").to_numpy()
            first, before = 0, np.concatenate([[0], np.cumsum(have)])
            while first < len(have):
                last = max(first + 1, int(np.searchsorted(before[1:], before[first] + PIECE // 8, "right")))
                sig, n, root = (batch.column(c)[first:last].to_numpy() for c in ("sig", "n", "root"))
                own = have[first:last]
                parts = lists[first:last].flatten()
                grams = string_bytes(parts)[0].view(np.uint64)
                owner = np.repeat(np.arange(len(own)), own)
                grams = grams[np.lexsort((grams, owner))]
                rows, of = _cut_grams(sig, n, own, grams, bits)
                words, ends = _sketches(own, grams)
                sketches = binary_array(words, ends * 8).take(pa.array(of))
                yield pa.record_batch([*rows.columns, pa.array(root[of]), pa.array(own[of]), sketches], [*rows.schema.names, "root", "have", "sketch"])
                first = last

    return cut


class _Fragment:
    """The sets of one fragment as flat arrays, entries sorted by (n-gram, set size, set)."""

    def __init__(self, table: pa.Table, known: pa.Table | None = None):
        sig, first = np.unique(table.column("sig").to_numpy(), return_index=True)
        table = table.take(pa.array(first)).combine_chunks()
        size = table.column("n").to_numpy()
        order = np.lexsort((sig, size))
        self.sig, self.size = sig[order], size[order]
        flat, ends = string_bytes(table.column("grams").combine_chunks())
        lengths = np.diff(ends, prepend=0) // 8
        place = np.empty(len(sig), np.int32)
        place[order] = np.arange(len(sig))
        self.owner = np.repeat(place, lengths)
        self.grams = flat.view(np.uint64)
        self.probes = table.column("probes").to_numpy()[order]
        self.here = lengths[order]  # n-grams of each set in this fragment
        self.label = self.have = None
        if known is not None:
            named, row = np.unique(known.column("known").to_numpy(), return_index=True)
            self.label = known.column("root").to_numpy()[row[np.searchsorted(named, self.sig)]]
        elif "sketch" in table.column_names:
            self.label, self.have = (table.column(c).to_numpy()[order] for c in ("root", "have"))
            bits, ends = string_bytes(table.column("sketch").combine_chunks())
            self.sketch, ends = bits.view(np.uint64), ends // 8
            words = np.diff(ends, prepend=0)
            self.at, self.words = (ends - words)[order], words[order]

    def shared_entries(self) -> None:
        """Keeps n-grams of several sets, by (n-gram, owner); which of them are look-ups; the group of each."""
        order = np.lexsort((self.owner, self.grams))
        grams, owner = self.grams[order], self.owner[order]
        self.grams = self.owner = order = None  # not needed any more
        begin = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0)
        run = np.diff(np.append(begin, len(grams)))
        often = np.repeat(run.astype(np.int32), run)
        size = np.bincount(owner, minlength=len(self.sig))
        rarest = np.lexsort((grams, often, owner)).astype(np.int32)
        grams = begin = None
        rank = np.empty(len(owner), np.int32)
        rank[rarest] = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        rarest = None
        self.score = np.bincount(owner, weights=np.log(often), minlength=len(self.sig)) / size if self.have is None else self.have / self.size
        keep = often > 1
        self.entry = owner[keep].astype(np.int64)
        self.probe = rank[keep] < self.probes[self.entry]
        self.run = run[run > 1]
        self.begin = np.cumsum(self.run) - self.run
        self.group = np.repeat(np.arange(len(self.run), dtype=np.int32), self.run)

    def linkable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sizes let a pair link: the intersection has at most what either set shares with other components."""
        most = np.minimum(self.size[a], self.size[b])
        if self.have is not None:
            most = np.minimum(most, np.minimum(self.have[a], self.have[b]))
        return most * OF >= (self.size[a] + self.size[b] - most) * LEAST

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """n-grams of this fragment that each pair has in common."""
        groups = len(self.run)
        order = np.argsort(self.entry, kind="stable")
        code = self.entry[order] * groups + self.group[order]
        starts = np.searchsorted(self.entry[order], np.arange(len(self.sig) + 1))
        width = starts[a + 1] - starts[a]
        upto = np.cumsum(width)
        found, k = np.zeros(len(a), np.int64), 0
        while k < len(a):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + EXPAND, "right")))
            w = width[k:stop]
            pair = np.repeat(np.arange(k, stop), w)
            into = np.arange(len(pair)) - np.repeat(np.cumsum(w) - w, w)
            wanted = b[pair] * groups + code[starts[a[pair]] + into] % groups
            at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            found += np.bincount(pair[code[at] == wanted], minlength=len(a))
            k = stop
        return found

    def hopeful(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a pair can link, seen what it has in common here and what its sets share elsewhere with other components."""
        elsewhere = self.have - self.here
        most = self.common(a, b) + np.minimum(elsewhere[a], elsewhere[b])
        return most * OF >= (self.size[a] + self.size[b] - most) * LEAST

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The similarity that each pair has at most, by the sketches of its sets."""
        found = np.zeros(len(a))
        if not len(a):
            return found
        kind = self.words[a] << 32 | self.words[b]
        for both in np.unique(kind):
            rows = np.flatnonzero(kind == both)
            wide = int(both) >> 32, int(both) & 0xFFFFFFFF
            step = max(1, EXPAND // max(wide))
            for k in range(0, len(rows), step):
                pair = rows[k : k + step]
                sides = []
                for of, w in zip((a[pair], b[pair]), wide, strict=True):  # the longer is folded to the shorter one's bits
                    bits = self.sketch[self.at[of][:, None] + np.arange(w)].reshape(len(pair), -1, min(wide))
                    sides.append(np.bitwise_xor.reduce(bits, axis=1))
                apart = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
                found[pair] = self.have[a[pair]] + self.have[b[pair]] - apart
        both = self.size[a] + self.size[b]
        return found / (2 * both - found)


def _beside(f: _Fragment) -> np.ndarray:
    """Each looked-up n-gram pairs its set with the next one in size that has it (with all, if they are few) and with the
    HUBS whose n-grams are the most common: the original and the least edited of its copies. Few pairs, most components."""
    steps = []
    for step in range(1, FEW):  # to the next in size; in groups of FEW sets at most, to all
        at = np.flatnonzero(f.probe[:-step] & (f.group[step:] == f.group[:-step]) & ((f.run[f.group[:-step]] <= FEW) | (step == 1)))
        steps.append((f.entry[at], f.entry[at + step]))
    by_score = f.entry[np.lexsort((f.score[f.entry], f.group))]
    own = np.flatnonzero(f.probe)
    group = f.group[own]
    for k in range(1, HUBS + 1):
        has = f.run[group] >= k
        hub = by_score[(f.begin + f.run - k)[group[has]]]
        steps.append((np.minimum(f.entry[own[has]], hub), np.maximum(f.entry[own[has]], hub)))
    a, b = (np.concatenate(side) for side in zip(*steps, strict=True))
    ok = (a != b) & f.linkable(a, b)
    return np.unique(a[ok] * len(f.sig) + b[ok])


def _neighbours(table: pa.Table) -> pa.Table:
    """The pairs of _beside. Each tells the n-grams it has in common here and those of either set."""
    f = _Fragment(table)
    f.shared_entries()
    if not len(f.entry):
        return pa.table([pa.array([], pa.int64())] * 4, ["a", "b", "common", "either"])
    code = _beside(f)
    a, b = code // len(f.sig), code % len(f.sig)
    common = f.common(a, b)
    return pa.table(
        [pa.array(f.sig[a]), pa.array(f.sig[b]), pa.array(common), pa.array(f.here[a] + f.here[b] - common)], ["a", "b", "common", "either"]
    )


def _across(partners: int | None):
    """All pairs that a look-up finds, that the links so far leave in different components and that can link by their sketches;
    or, of such pairs as _beside makes, those with the partners most alike of each set, by their sketches.

    The pairs are looked at about EXPAND at a time, and only those kept are held.
    """

    def across(segments: pa.Table) -> pa.Table:
        f = _Fragment(segments)
        f.shared_entries()
        held, found = _kept(f, [], partners), []
        for code in _met(f) if partners is None else [_beside(f)] if len(f.entry) else []:
            a, b = code // len(f.sig), code % len(f.sig)
            code = code[f.label[a] != f.label[b]]
            alike = f.alike(code // len(f.sig), code % len(f.sig))
            found.append((code[alike >= LEAST / OF], alike[alike >= LEAST / OF]))
            if sum(len(c) for c, _ in found) >= EXPAND:
                held, found = _kept(f, [held, *found], partners), []
        code, alike = _kept(f, [held, *found], partners)
        a, b = code // max(1, len(f.sig)), code % max(1, len(f.sig))
        if partners is None:
            ok = f.hopeful(a, b)
            a, b, alike = a[ok], b[ok], alike[ok]
        return pa.table([pa.array(f.sig[a]), pa.array(f.sig[b]), pa.array(alike)], ["a", "b", "alike"])

    return across


def _leads(f: _Fragment, root: np.ndarray) -> np.ndarray:
    """The entries that are set against all others of their n-gram: those outside its sets' main component, or those that look it
    up if they are fewer. A set's come together."""
    probing = np.add.reduceat(f.probe, f.begin, dtype=np.int64)
    order = np.lexsort((root, f.group))
    group, label = f.group[order], root[order]
    new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    count = np.diff(np.append(new, len(order)))
    group, label = group[new], label[new]
    order = np.lexsort((count, group))
    last = order[np.flatnonzero(np.diff(group[order], append=-1))]
    main, largest = label[last], count[last]
    fewer = probing < f.run - largest
    mixed_groups = (largest < f.run) & (probing > 0)
    lead = np.flatnonzero(mixed_groups[f.group] & np.where(fewer[f.group], f.probe, root != main[f.group])).astype(np.int32)
    return lead[np.argsort(f.entry[lead], kind="stable")]


def _met(f: _Fragment) -> Iterator[np.ndarray]:
    """All pairs across components that a look-up finds, some EXPAND at a time; a pair may come more than once."""
    if not len(f.entry):
        return
    root = np.unique(f.label, return_inverse=True)[1].astype(np.int32)[f.entry]
    lead = _leads(f, root)
    upto = np.cumsum(f.run[f.group[lead]])
    k = 0
    while k < len(lead):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + EXPAND, "right")))
        group = f.group[lead[k:stop]]
        w = f.run[group]
        x = np.repeat(lead[k:stop], w)
        y = np.arange(len(x), dtype=np.int32) + np.repeat(f.begin[group] - np.cumsum(w) + w, w).astype(np.int32)
        low, high = np.minimum(x, y), np.maximum(x, y)  # entries of a group are in order of size
        ok = f.probe[low] & (root[x] != root[y])
        code = np.unique(f.entry[low[ok]] * len(f.sig) + f.entry[high[ok]])
        yield code[f.linkable(code // len(f.sig), code % len(f.sig))]
        k = stop


def _kept(f: _Fragment, found: list[tuple[np.ndarray, np.ndarray]], partners: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once; only those that are among the partners most alike of either set, if these are limited."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    code, alike = (np.concatenate(x) for x in zip(*found, strict=True))
    code, first = np.unique(code, return_index=True)
    alike = alike[first]
    if partners is not None and len(code):
        side = np.concatenate([code // len(f.sig), code % len(f.sig)])
        order = np.lexsort((np.tile(code, 2), -np.tile(alike, 2), side))
        begin = np.flatnonzero(np.diff(side[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        ok = np.unique(order[rank < partners] % len(code))
        code, alike = code[ok], alike[ok]
    return code, alike


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs (a, b, alike) the PARTNERS most alike.

    So the pairs that are checked grow with the sets and not with the fragments. What is left out here and still lies
    across components is met again in the last round, which keeps all.
    """
    sides = pairs.select("*", F.explode(F.array("a", "b")).alias("side"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("alike"), "a", "b"))
    return sides.withColumn("rank", rank).filter(F.col("rank") <= PARTNERS).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of similarity LEAST / OF or more. A pair is one row here, however many fragments its sets lie in."""
    pairs = written(pairs.distinct(), "jaccard-pairs")
    of_a, of_b = (sets.select(F.col("sig").alias(side), F.col("grams").alias(f"grams_{side}")) for side in ("a", "b"))
    common = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    both = F.size("grams_a").cast("long") + F.size("grams_b")
    return pairs.join(of_a, "a").join(of_b, "b").filter(common * (OF + LEAST) >= both * LEAST).select("a", "b")


def _open(segments: DataFrame, roots: DataFrame) -> DataFrame:
    """The fragments of the sets that can still be linked with another component: of the n-grams of a set, needed must be in
    sets of other components. n-grams of one component alone are left out."""
    where = segments.select(F.col("sig").alias("known"), F.col("fragment").alias("there"))
    told = where.join(roots.withColumnRenamed("node", "known"), "known", "left").select("there", "known", F.coalesce("root", "known").alias("root"))
    parts = segments.select("sig", "n", "fragment", "probes", "grams").groupBy("fragment").cogroup(told.groupBy("there"))
    sets = parts.applyInArrow(_outside, "sig long, n long, root long, grams binary").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("root").alias("root"), F.sum(F.octet_length("grams") / 8).cast("long").alias("have"), F.collect_list("grams").alias("grams")
    )
    sets = written(sets.filter(F.col("have") * OF >= F.col("n") * LEAST), "jaccard-open")
    bits = _bits(2 * sets.agg(F.coalesce(F.sum("have"), F.lit(0))).first()[0])  # smaller fragments, as the sketches come on top
    cut = sets.mapInArrow(_cut_open(bits), "sig long, n long, fragment long, probes long, grams binary, root long, have long, sketch binary")
    return written(cut, "jaccard-segments")


def _bits(grams: int) -> int:
    return max(0, (-(-grams // FRAGMENT) - 1).bit_length())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id.

    A text's set: its distinct five-word n-grams (A-Z lowered, words between blanks), all its words as one n-gram if
    they are fewer. Two texts link when their sets' similarity is 0.8 or more; component_id is the smallest doc_id that
    links reach, class_id names the texts of one and the same set.

    Null, empty and blank texts have no set: n_shingles 0, class_id null, linked with nothing, component_id the own id.
    Rows of equal id are separate texts; null ids are never the smallest unless there is no other. Equal sets are
    one class whatever the order of words behind them; n-grams and classes are compared by 64-bit hashes. Other columns
    are not read. An empty table gives an empty result.

    Plan (vertical partitioning): the n-gram order is cut by hash into fragments of about two million n-grams. First, fragments
    tell how many n-grams of each set any other set has; a set needs 80 % of its own, which few have. Texts of
    one document per remaining class are then cut into fragments. In each, every set looks up its rarest n-grams,
    enough in all fragments together that one look-up must meet any partner. Fragments count the overlap of the pairs they
    meet; the sums per pair rank a set's candidates, and those kept are checked by intersecting the two sets, one row a pair.
    Candidates come in three rounds, neighbours in size first: components joined by them need no further pairs, so large
    groups of copies cost a few pairs per document instead of all pairs. Then only sets that share enough n-grams with other
    components are left, cut anew into fragments by these n-grams alone, each with a sketch of a few bits per n-gram that tells
    how alike a pair can be at most: first the most alike of each set across components, then all pairs that still lie across
    components. Pairs that cannot link by their sketches are not sent.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *row_key(F.col("doc_id"), F.col("text")))
    kind = docs.schema[id_col].dataType.simpleString()
    digests = written(rows.mapInArrow(_digests, f"doc_id {kind}, k1 long, k2 long, n long, sig long"), "jaccard-digests")
    total = digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = digests.filter("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min(F.struct("k1", "k2")).alias("k")
    )
    survivors = (
        rows.select("text").mapInArrow(_scattered(_bits(total)), "fragment long, task int, piece int, sets int, keys binary, which binary")
        .groupBy("fragment").applyInArrow(_shared, "task int, piece int, meta boolean, data binary")
        .groupBy("task", "piece").applyInArrow(_survivors, "sig long")
        .distinct()
    )
    chosen = written(classes.join(survivors, "sig").select("sig", "n", "k.*"), "jaccard-survivors")
    left, grams = chosen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = _bits(grams)
    keys = chosen.select("k1", "k2")
    texts = rows.join(F.broadcast(keys) if left <= SMALL else keys, ["k1", "k2"], "left_semi").select("text")
    sets = written(texts.mapInArrow(_whole, "sig long, grams array<long>").dropDuplicates(["sig"]), "jaccard-sets")
    segments = written(sets.mapInArrow(_cut(bits), "sig long, n long, fragment long, probes long, grams binary"), "jaccard-segments")

    found = segments.groupBy("fragment").applyInArrow(_neighbours, "a long, b long, common long, either long")
    summed = written(found, "jaccard-neighbours").groupBy("a", "b").agg((F.sum("common") / (F.sum("either") + DOUBT)).alias("alike"))
    links = written(_links(_likeliest(summed), sets), "jaccard-links")
    roots = written(components(links), "jaccard-roots")
    for partners in (PARTNERS, None):
        segments = _open(segments, roots)
        pairs = segments.groupBy("fragment").applyInArrow(_across(partners), "a long, b long, alike double")
        if partners is not None:
            pairs = _likeliest(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")))
        links = written(links.unionByName(_links(pairs.select("a", "b"), sets)), "jaccard-links")
        roots = written(components(links), "jaccard-roots")

    rooted = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(smallest, "root").select(F.col("sig").alias("class_id"), "component_id"), "jaccard-classes")
    return (
        digests.withColumnRenamed("sig", "class_id").join(named, "class_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )
