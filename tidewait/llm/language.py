"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import pieces, string_bytes

OTHER = 0  # one symbol for a run of anything that is no letter
FIRST_LETTER = 1
PIECE = 4 << 20  # bytes of text worked on in one go
SPAN = 512  # symbols parsed in one go; a phrase ends where a span ends


def learn(
    labelled: DataFrame, sample_docs: int = 32, sample_chars: int = 1024, total_chars: int = 1 << 22,
    text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
) -> dict[str, str]:
    """Sample text of every label: the sample_docs texts of the smallest id hashes (texts under 200 characters only
    if there are no others), sample_chars characters of each. No label is left out: where there are so many that
    these would exceed total_chars characters, each label gets an equal share of total_chars instead, in fewer texts, then
    in shorter ones. So at most total_chars characters (one per label at least) reach the driver, however many labelled
    rows there are. Null labels and null texts teach nothing."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = max(1, rows.agg(F.count_distinct(F.col(lang_col).cast("string"))).first()[0])
    docs, chars = shares(labels, sample_docs, sample_chars, total_chars)
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"), (F.length(text_col) < 200).alias("short"),
        F.xxhash64(F.col(id_col), F.lit("sample")).alias("h"), F.substring(F.col(text_col), 1, chars).alias("text"),
    )
    # The limit on ranks runs before the shuffle too, so a language of half of all rows sends its share a task.
    first = Window.partitionBy("lang").orderBy("short", "h", "text")
    chosen = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= docs)
    found: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "r").select("lang", "text").collect():
        found.setdefault(row.lang, []).append(row.text)
    return {lang: "\n".join(texts) for lang, texts in found.items()}


def shares(labels: int, docs: int, chars: int, total: int) -> tuple[int, int]:
    """Texts of each label and characters of each text, so that all labels together keep to the total."""
    docs = max(1, min(docs, total // (labels * chars)))
    return docs, max(1, min(chars, total // (labels * docs)))


@lru_cache(maxsize=4)
def _automata(samples: tuple[tuple[str, str], ...]):
    """Byte classes and, per language, a transition table and the bits one phrase costs.

    Symbols are the bytes of letters (A-Z lowered) seen in any sample, one for a run of other ASCII, one for
    other bytes above ASCII. A symbol that the sample lacks is a phrase by itself.
    """
    letters = np.zeros(256, np.uint8)
    letters[97:123] = np.arange(FIRST_LETTER, FIRST_LETTER + 26)
    letters[65:91] = letters[97:123]
    seen = sorted({b for _, text in samples for b in text.encode() if b >= 128})
    unknown = FIRST_LETTER + 26 + len(seen)
    letters[128:] = unknown
    for k, b in enumerate(seen):
        letters[b] = FIRST_LETTER + 26 + k
    width = unknown + 1
    tables, costs = [], []
    for _, text in samples:
        symbols = _collapsed(letters[np.frombuffer(text.encode(), np.uint8)]).tolist()
        tables.append(_table(symbols, width))
        costs.append(float(np.log2(max(2, len(symbols)))))
    return letters, tables, costs


def _collapsed(symbols: np.ndarray) -> np.ndarray:
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != OTHER) | (symbols[:-1] != OTHER)
    return symbols[keep]


class Table(NamedTuple):
    """Transitions of one automaton, rows of all states laid into each other.

    The entry of (state, symbol) is at base[state] + symbol if its upper half names that state; the lower half is the next
    state. Any other entry means that the state has no such transition: a phrase begins, and the root's next state holds."""

    base: np.ndarray
    entry: np.ndarray
    root: np.ndarray


def _table(symbols: list[int], width: int) -> Table:
    """Suffix automaton by online construction: it accepts exactly the substrings of the sample. Some 14 bytes a transition."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = state
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                split = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = split
                    p = link[p]
                link[q] = link[state] = split
        last = state
    root = np.zeros(width, np.int64)
    for c, to in after[0].items():
        root[c] = to
    return Table(*_interleaved(after, width), root)


def _interleaved(after: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with several transitions go to the next place where they fit; those with one fill the gaps. The root has none."""
    total = sum(map(len, after[1:]))
    used = bytearray(width * (len(after) + 2) + total)
    base = np.zeros(len(after), np.int32)
    several = sorted((s for s in range(1, len(after)) if len(after[s]) > 1), key=lambda s: -len(after[s]))
    top = 0
    place = 0
    for size, states in groupby(several, lambda s: len(after[s])):
        place = 0 if size == 2 else place
        for s in states:
            row = sorted(after[s])
            while used[place + row[0]] or used[place + row[-1]] or any(used[place + c] for c in row):
                place += 1
            for c in row:
                used[place + c] = 1
            base[s] = place
            top = max(top, place)
    single = [s for s in range(1, len(after)) if len(after[s]) == 1]
    letter = np.array([next(iter(after[s])) for s in single], np.int32)
    free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0)[: len(single)].astype(np.int32) + width
    base[single] = free - letter
    size = int(max(base.max(initial=0), top)) + width
    entry = np.full(size, -1, np.int64)
    states = np.repeat(np.arange(1, len(after)), [len(row) for row in after[1:]])
    keys = np.fromiter((c for row in after[1:] for c in row), np.int64, total)
    nexts = np.fromiter((to for row in after[1:] for to in row.values()), np.int64, total)
    entry[base[states] + keys] = states << 32 | nexts
    return base, entry


def phrase_counts(symbols: np.ndarray, ends: np.ndarray, tables: list[Table]) -> np.ndarray:
    """Phrases of the greedy cross-parse of each text in each language, texts in spans of SPAN symbols side by side."""
    sizes = np.diff(ends, prepend=0)
    spans = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(ends)), spans)
    at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    begin = np.repeat(ends - sizes, spans) + at * SPAN
    left = np.minimum(SPAN, sizes[owner] - at * SPAN)
    order = np.argsort(-left, kind="stable")
    owner, begin, left = owner[order], begin[order], left[order]
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    counts = np.zeros((len(tables), len(ends)), np.int64)
    steps = [symbols[begin[:k] + p] for p, k in enumerate(active)]
    for which, table in enumerate(tables):
        state = np.zeros(len(owner), np.int64)
        failed = np.zeros(len(owner), np.int64)
        for p, k in enumerate(active):
            here, symbol = state[:k], steps[p]
            entry = table.entry[table.base[here] + symbol]
            fresh = (entry >> 32) != here
            failed[:k] += fresh
            state[:k] = np.where(fresh, table.root[symbol], entry & 0xFFFFFFFF)
        counts[which] = np.bincount(owner, weights=failed, minlength=len(ends)).astype(np.int64)
    return counts


def _judge(samples: tuple[tuple[str, str], ...]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, tables, costs = _automata(samples)
        names = np.array([lang for lang, _ in samples] + ["und"], dtype=object)
        for batch in pieces(batches, "text", PIECE):
            data, ends = string_bytes(batch.column("text"))
            symbols = letters[data]
            keep = np.ones(len(symbols), bool)
            keep[1:] = (symbols[1:] != OTHER) | (symbols[:-1] != OTHER)
            keep[ends[:-1][ends[:-1] < len(symbols)]] = True
            kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[ends]
            symbols = symbols[keep]
            lettered = _lettered(batch.column("text"), data, ends)
            if len(tables):
                bits = phrase_counts(symbols, kept, tables) * np.array(costs)[:, None]
                best = bits.argmin(axis=0)
                least = bits[best, np.arange(len(ends))]
                bits[best, np.arange(len(ends))] = np.inf
                second = bits.min(axis=0) if len(tables) > 1 else np.full(len(ends), np.inf)
                score = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0.0)
            else:
                best, score = np.full(len(ends), -1), np.zeros(len(ends))
            best = np.where(lettered, best, -1)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()),
                    pa.array(np.where(best >= 0, np.clip(score, 0, 1), 0.0)),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return judge


def _lettered(texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    plain = np.zeros(len(data) + 1, np.int32)
    low = data | 32
    np.cumsum((low >= 97) & (low <= 122), out=plain[1:])
    has = plain[ends] > plain[np.concatenate([[0], ends[:-1]])]
    for k in np.flatnonzero(~has):
        text = texts[int(k)].as_py()
        has[k] = text is not None and any(c.isalpha() for c in text)
    return has


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Each text is parsed in each language into the longest pieces that the language's sample contains; the
    language whose phrases cost the fewest bits (phrases times log2 of the sample's length) wins, ties by order
    of name. The whole text counts, in spans of 512 symbols. score is 1 less the ratio of the best cost to the
    second best: 0 at a tie, 1 where only one language was learnt.

    Null text, and text without a letter: `und`, score 0. Without samples all is `und`. Rows of equal id are
    judged each by itself; a null id is hashed as an empty text. Other columns are not read.

    Plan: one pass without a shuffle. The samples (bounded, see learn) travel with the task; a worker builds
    the automata once (some 2 MB for a full sample, 250 MB at most for total_chars) and steps through all spans of a
    piece of text at a time with array look-ups.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    fixed = tuple(sorted(samples.items()))
    return rows.mapInArrow(_judge(fixed), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
