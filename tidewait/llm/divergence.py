"""Source divergence audit: a minimal acyclic transducer holds the vocabulary and counts the text that streams through it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import pieces, string_bytes, written
from tidewait.llm.transducer import LOWERED, TERM, Transducer, build, ordinals, term_spans

SHARD = 1 << 16  # terms of one transducer
PACK = 32 << 20  # bytes of transducers that travel with the tasks at once
HELD = 1 << 19  # different (group, term) counts a task holds before it sends them on
BLOCK = 256  # terms of a row of counts
UNIT = 1_000_000_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many texts of a piece of the task's rows each term stands."""
    for batch in pieces(batches, "text"):
        data, ends = string_bytes(batch.column("text"))
        starts, stops, per_text = term_spans(data, ends)
        if not len(starts):
            continue
        # Terms are all the term bytes there are, so these are the terms one after the other.
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[TERM[data]]])).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        once = np.unique(np.repeat(np.arange(len(ends)), per_text) << 32 | code)
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, n = np.unique(lang[once >> 32] << 32 | once & 0xFFFFFFFF, return_counts=True)
        yield pa.record_batch([langs.dictionary.take(pa.array(pairs >> 32)), terms.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(n)], ["lang", "term", "n"])


def vocabulary(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term): the terms found in at least so many documents of the language. Counts merge before the shuffle."""
    found = docs.select("lang", "text").mapInArrow(_found, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def _built(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of = None

        def shard() -> pa.RecordBatch:
            return pa.record_batch([pa.array([of]), pa.array([held[0].decode()]), pa.array([len(held)], pa.int64()), pa.array([build(held).packed()])], ["lang", "first", "n_terms", "machine"])

        for batch in batches:
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (lang != of or len(held) == most):
                    yield shard()
                    held.clear()
                of = lang
                held.append(term.encode())
        if held:
            yield shard()

    return shards


def transducers(terms: DataFrame, most: int = SHARD) -> DataFrame:
    """(lang, first, n_terms, machine, begin): runs of each language's sorted terms, and the ordinal of a run's first term.

    Terms are sorted by ranges over tasks; a task builds one transducer after the other as the terms pass."""
    runs = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    runs = written(runs.mapInArrow(_built(most), "lang string, first string, n_terms long, machine binary"), "audit-transducers")
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("begin", F.coalesce(F.sum("n_terms").over(before), F.lit(0).cast("long")))


def _packs(runs: DataFrame) -> Iterator[list]:
    """The transducers, at most PACK bytes of them at a time (one at least)."""
    pack, size = [], 0
    for run in runs.select("lang", "begin", "machine").orderBy("lang", "begin").toLocalIterator():
        if pack and size + len(run.machine) > PACK:
            yield pack
            pack, size = [], 0
        pack.append((run.lang, run.begin, bytes(run.machine)))
        size += len(run.machine)
    if pack:
        yield pack


def _machines(pack: list) -> dict[str, list[tuple[int, Transducer]]]:
    found: dict[str, list[tuple[int, Transducer]]] = {}
    for lang, begin, machine in pack:
        found.setdefault(lang, []).append((begin, Transducer.unpacked(machine)))
    return found


def _walked(machines: list[tuple[int, Transducer]], data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), -1, np.int64)
    for begin, machine in machines:
        found = ordinals(machine, data, starts, stops)
        out = np.where(found >= 0, found + begin, out)
    return out


def _recount(pack: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of kept terms per (lang, source, ordinal), summed within the task before they are sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _machines(pack)
        groups: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            group = keys >> 40
            lang, source = (pa.array([n[k] for n in names], pa.string()).take(pa.array(group)) for k in (0, 1))
            return pa.record_batch([lang, source, pa.array(keys & ((1 << 40) - 1)), pa.array(sums)], ["lang", "source", "ordinal", "n"])

        for batch in pieces(batches, "text", 1 << 20):
            data, ends = string_bytes(batch.column("text"))
            if not len(data):
                continue
            data = LOWERED[data]
            starts, stops, per_text = term_spans(data, ends)
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for pair in zip(langs, sources, strict=True):
                if pair not in groups:
                    groups[pair] = len(names)
                    names.append(pair)
            group = np.repeat([groups[p] for p in zip(langs, sources, strict=True)], per_text)
            fresh = [keys]
            for lang in set(langs) & machines.keys():
                mine = np.flatnonzero(np.repeat([x == lang for x in langs], per_text))
                found = _walked(machines[lang], data, starts[mine], stops[mine])
                fresh.append((group[mine].astype(np.int64) << 40 | found)[found >= 0])
            joined = np.concatenate(fresh)
            keys, at = np.unique(joined, return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, np.ones(len(joined) - len(sums))]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield sent()
                keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield sent()

    return count


def _numbered(pack: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ordinals of terms: each passes through its language's transducers like text."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _machines(pack)
        for batch in batches:
            data, ends = string_bytes(batch.column("term"))
            starts, langs = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.array(batch.column("lang").to_pylist(), object)
            found = np.full(len(ends), -1, np.int64)
            for lang in set(langs) & machines.keys():
                mine = np.flatnonzero(langs == lang)
                found[mine] = _walked(machines[lang], data, starts[mine], ends[mine])
            yield pa.record_batch([batch.column("lang"), batch.column("term"), pa.array(found)], ["lang", "term", "ordinal"]).filter(pa.array(found >= 0))

    return number


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 v)), exact in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (cast({n} + 5 AS DECIMAL(38, 0)) * {UNIT}) div cast({total} + 5 * v AS DECIMAL(38, 0))")


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Differences of every two sources of a language, summed over its kept terms block by block."""
    blocks = counts.groupBy("lang", "source", F.expr(f"ordinal div {BLOCK}").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("ordinal") % BLOCK).cast("int"), "n"))).alias("found")
    )
    wide = groups.filter("v > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (v - 1) div {BLOCK})")))
    wide = wide.join(blocks, ["lang", "source", "block"], "left")
    dense = F.expr(f"transform(sequence(0, cast(least({BLOCK}, v - {BLOCK} * block) AS INT) - 1), i -> coalesce(found[i], 0L))")
    shares = F.expr(f"transform(dense, n -> 1 + (cast(n + 5 AS DECIMAL(38, 0)) * {UNIT}) div cast(total + 5 * v AS DECIMAL(38, 0)))")
    wide = wide.withColumn("dense", dense).withColumn("shares", shares)
    wide = written(wide.select("lang", "source", "block", "shares"), "audit-shares")
    other = wide.select("lang", "block", F.col("source").alias("item"), F.col("shares").alias("others"))
    apart = F.expr("aggregate(zip_with(shares, others, (x, y) -> abs(x - y)), 0L, (s, x) -> s + x)")
    half = wide.join(other, ["lang", "block"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(apart).alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    names = groups.select("lang", "source")
    every = names.join(names.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    found = every.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(groups: DataFrame, counts: DataFrame, numbers: DataFrame, first: int) -> DataFrame:
    """The terms a group uses most above its language; ordinals decide ties and become terms again at the end."""
    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n_lang"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    shares = counts.join(groups, ["lang", "source"]).join(of_lang, ["lang", "ordinal"]).join(totals, "lang")
    shares = shares.withColumn("value", _share("n", "total") - _share("n_lang", "total_lang")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = shares.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    top = top.join(numbers, ["lang", "ordinal"])
    return top.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def source_divergence(
    docs: DataFrame, min_docs: int = 30, first: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """How sources of a language differ in their use of its terms: lang, source, part, item, value, rank.

    Terms are runs of letters and of characters beyond ASCII, A-Z lowered. A language keeps the terms of at least
    min_docs of its documents. Every (lang, source) and every language gives each of its v kept terms the share
    1 + floor(10**9 * (n + 5) / (N + 5 v)), n its occurrences there, N those of all kept terms; all numbers are whole.
    Part `pair`: every other source of the language with the sum of share differences (0 where no term is kept). Part
    `term`: the `first` terms that occur in the group and have a greater share there than in the language, with the difference.
    Ranks go by falling value, ties by the item's bytes.

    Kept terms in byte order become minimal acyclic transducers, whose ordinals number them; the texts are then
    streamed through them, each term walking the edges of its bytes, and counted by ordinal. Ordinals decide ties; the
    terms of the report get theirs by passing through too.

    Null text, lang and source count as ''. Equal rows, and rows of equal id, are documents of their own. A language of one source
    has no pairs. An empty table gives no rows. Other columns are not read; texts are read whole.

    Plan: two passes over the texts, without moving them: one for the vocabulary (counts merge before the shuffle),
    one per PACK bytes of transducers, so neither the driver nor a task holds more of a vocabulary than that. Counts are summed
    in the task before they are sent. Sources are compared by blocks of terms.
    """
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept = written(vocabulary(own, min_docs), "audit-terms")
    runs = written(transducers(kept), "audit-runs")
    counts = docs.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")
    numbers = docs.sparkSession.createDataFrame([], "lang string, term string, ordinal long")
    for pack in _packs(runs):
        langs = sorted({p[0] for p in pack})
        part = own.filter(F.col("lang").isin(langs)).mapInArrow(_recount(pack), counts.schema)
        part = part.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(written(part, "audit-counts"))
        part = kept.filter(F.col("lang").isin(langs)).mapInArrow(_numbered(pack), numbers.schema)
        numbers = numbers.unionByName(written(part, "audit-numbers"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = runs.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = written(groups.fillna(0, ["total", "v"]), "audit-groups")
    return _pairs(groups, counts).unionByName(_terms(groups, counts, numbers, first))
