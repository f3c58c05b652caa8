"""Minimal acyclic transducers from terms to lexicographic ordinals, walked by all terms of a batch in step."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


class Transducer(NamedTuple):
    """edges: state * 256 + byte of every edge, sorted; target: where it leads; skip: what it adds to the ordinal;
    final: which states end a term; the last state is the root."""

    edges: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    final: np.ndarray

    def packed(self) -> bytes:
        sizes = np.array([len(self.edges), len(self.final)], np.int64)
        return b"".join([sizes.tobytes(), self.edges.tobytes(), self.target.tobytes(), self.skip.tobytes(), self.final.tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        n, m = np.frombuffer(data, np.int64, 2)
        parts, at = [], 16
        for kind, size in ((np.int64, n), (np.int32, n), (np.int32, n), (np.bool_, m)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += int(size) * np.dtype(kind).itemsize
        return cls(*parts)


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal automaton of distinct terms in ascending order of their bytes.

    A term shares the path of the one before as far as both agree. The rest of that path can get no more edges and is
    settled from its end: a state with the same edges and the same end mark as an earlier one becomes that one. The
    number of terms below each state makes the ordinals."""
    settled: dict[tuple, int] = {}
    states: list[tuple] = []
    below: list[int] = []
    path: list[list] = [[False, {}]]  # open states: end mark, edges; the newest edge of each leads to the next one
    labels: list[int] = []

    def settle(depth: int) -> None:
        while len(labels) > depth:
            is_end, edges = path.pop()
            form = (is_end, tuple(edges.items()))
            if form not in settled:
                settled[form] = len(states)
                states.append(form)
                below.append(is_end + sum(below[t] for t in edges.values()))
            path[-1][1][labels.pop()] = settled[form]

    before = b""
    for term in terms:
        shared = 0
        while shared < min(len(before), len(term)) and before[shared] == term[shared]:
            shared += 1
        settle(shared)
        for byte in term[shared:]:
            labels.append(byte)
            path.append([False, {}])
        path[-1][0] = True
        before = term
    settle(0)
    states.append((path[0][0], tuple(path[0][1].items())))

    edges, target, skip = [], [], []
    for state, (is_end, out) in enumerate(states):
        passed = int(is_end)
        for byte, to in out:
            edges.append(state * 256 + byte)
            target.append(to)
            skip.append(passed)
            passed += below[to]
    return Transducer(np.array(edges, np.int64), np.array(target, np.int32), np.array(skip, np.int32), np.array([s[0] for s in states], bool))


def term_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the terms of concatenated texts start and stop, and how many each text has; no term crosses texts."""
    inside = TERM[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.diff(np.searchsorted(starts, ends, "left"), prepend=0)


def ordinals(machine: Transducer, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The ordinal of every term data[start:stop], or -1: a byte of all terms still alive is read in each step."""
    out = np.full(len(starts), -1, np.int64)
    if not len(machine.edges):
        return out
    alive, state, sums = np.arange(len(starts)), np.full(len(starts), len(machine.final) - 1), np.zeros(len(starts), np.int64)
    at, stop = starts.copy(), stops
    while len(alive):
        ended = at >= stop
        if ended.any():
            arrived = ended & machine.final[state]
            out[alive[arrived]] = sums[arrived]
            alive, state, sums, at, stop = (x[~ended] for x in (alive, state, sums, at, stop))
        wanted = state * 256 + data[at]
        edge = np.minimum(np.searchsorted(machine.edges, wanted), len(machine.edges) - 1)
        going = machine.edges[edge] == wanted
        edge = edge[going]
        alive, at, stop = alive[going], at[going] + 1, stop[going]
        sums = sums[going] + machine.skip[edge]
        state = machine.target[edge].astype(np.int64)
    return out
