"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import LETTER_OR_DIGIT, pieces, row_key, string_bytes, word_hashes, written

BLOCK_TERMS = 1 << 20  # test terms sent to the tasks at a time: 8 MB


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        h, counts = word_hashes(*string_bytes(batch.column("text")), LETTER_OR_DIGIT)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
        yield pa.record_batch([batch.column("item"), batch.column("item_id"), terms], ["item", "item_id", "terms"])


class _Lookup:
    """Finds words in a sorted set of term hashes, most misses by one bit table."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.view(np.uint64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known terms, and which term each is."""
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        which = np.searchsorted(self.terms, h[at])
        hit = self.terms[np.minimum(which, len(self.terms) - 1)] == h[at]
        return at[hit], which[hit]


def _term_counts(terms: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lookup(terms)
        total = np.zeros(len(terms), np.int64)
        for batch in pieces(batches, "text"):
            h, _ = word_hashes(*string_bytes(batch.column("text")), LETTER_OR_DIGIT)
            total += np.bincount(known.find(h)[1], minlength=len(terms))
        yield pa.record_batch([pa.array(known.terms.view(np.int64)), pa.array(total)], ["term", "n"])

    return count


def _postings(terms: np.ndarray):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lookup(terms)
        for batch in pieces(batches, "text"):
            h, counts = word_hashes(*string_bytes(batch.column("text")), LETTER_OR_DIGIT)
            at, which = known.find(h)
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, at, "right")
            order = np.lexsort((at, which, doc))
            at, which, doc = at[order], which[order], doc[order]
            new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(which, prepend=-1))
            places = pa.array((at - (ends - counts)[doc]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), places)
            rows = pa.array(doc[new])
            yield pa.record_batch(
                [batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(known.terms.view(np.int64)[which[new]]), lists],
                ["k1", "k2", "term", "places"],
            )

    return post


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each candidate window with the document word by word; counts words inside true ones."""
    for batch in pieces(batches, "text"):
        h, counts = word_hashes(*string_bytes(batch.column("text")), LETTER_OR_DIGIT)
        ends = np.cumsum(counts)
        found = batch.column("found")
        per_doc = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), per_doc)
        flat = found.flatten()
        start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
        terms = flat.field("terms")
        length = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ok = (start >= 0) & (start + length <= counts[doc])
        first = (ends - counts)[doc] + start
        into = np.cumsum(length) - length
        place = np.repeat(np.where(ok, first, 0) - into, length) + np.arange(length.sum())
        values = terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        if len(length):
            bad = np.zeros(len(values) + 1, np.int64)
            bad[1:] = np.cumsum(h[np.minimum(place, len(h) - 1)] != values if len(h) else np.ones(len(values), bool))
            ok &= bad[into + length] == bad[into]
        hit = np.zeros(len(h) + 1, np.int64)
        np.add.at(hit, first[ok], 1)
        np.add.at(hit, (first + length)[ok], -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        items: dict[int, set[str]] = {}
        named = flat.field("item_id")
        for k in np.flatnonzero(ok):
            name = named[int(k)].as_py()
            if name is not None:
                items.setdefault(int(doc[k]), set()).add(name)
        listed = [sorted(items.get(k, ())) for k in range(batch.num_rows)]
        yield pa.record_batch(
            [
                batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(inside[ends] - inside[ends - counts]),
                pa.array(listed, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]), batch.column("n_near"),
            ],
            ["doc_id", "n_words", "n_hit", "items", "items_sha256", "n_near"],
        )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 8, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (sorted ids as strings), items_sha256, n_near.

    Words are runs of ASCII letters and digits and of all characters above ASCII, A-Z lowered. An item's windows
    are its runs of `window` words, or all its words if it has fewer. A document word inside any exact
    occurrence of a window is hit. n_near counts items of which some window's two rarest terms stand in the
    document within `slop` words of their distance in the item (exact places included): the proximity matches.

    Null or empty texts have no words; items without words match nothing. Rows of equal id are judged each by
    itself; items of equal id count once; an item without id hits words but can't be listed. Other columns are not
    read, whatever their names. Without items nothing is hit; without documents the result is empty.

    Plan: term counts over all documents (one row per term and task) tell each window's two rarest terms.
    Postings (document, term, places) are kept for those terms only. Joined with the items' places they give
    offset-adjusted positions: both rarest terms of a window on one offset, or near it, make a match. Exact matches
    are candidates that are then compared word by word in the one pass that reads each text beside its
    candidates. Test terms go to the tasks in blocks of 2**20 at most, however many items there are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *row_key(F.col("doc_id"), F.col("text")))
    source = items.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    source = source.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").distinct()
    listed = written(
        source.mapInArrow(_item_terms, "item long, item_id string, terms array<long>").filter(F.size("terms") > 0), "items"
    )
    vocabulary = written(listed.select(F.explode("terms").alias("term")).distinct(), "item-vocabulary")
    counted = None
    for block in _blocks(vocabulary):
        part = rows.select("text").mapInArrow(_term_counts(block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = spark.createDataFrame([], "term long, n long")
    counted = written(counted, "term-counts")

    size = F.least(F.lit(window), F.size("terms"))
    places = (
        listed.select("item", F.explode(F.sequence(F.lit(0), F.size("terms") - size)).alias("start"), size.alias("length"), "terms")
        .select("item", "start", "length", F.posexplode(F.slice("terms", F.col("start") + 1, F.col("length"))).alias("at", "term"))
        .withColumn("at", F.col("at") + F.col("start"))
        .join(counted, "term")
    )
    rarest = places.withColumn("r", F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "at"))).filter("r <= 2")
    keys = written(rarest.select("item", "at", "term").distinct(), "key-terms")
    windows = written(
        rarest.groupBy("item", "start", "length").agg(F.min_by("at", "r").alias("a"), F.max_by("at", "r").alias("b"))
        .groupBy("item").agg(F.collect_list(F.struct("start", "length", "a", "b")).alias("windows")),
        "item-windows",
    )
    postings = None
    for block in _blocks(keys.select("term").distinct()):
        part = rows.select("k1", "k2", "text").mapInArrow(_postings(block), "k1 long, k2 long, term long, places array<int>")
        postings = part if postings is None else postings.unionByName(part)
    if postings is None:
        postings = spark.createDataFrame([], "k1 long, k2 long, term long, places array<int>")
    postings = written(postings, "postings")

    shifted = (
        postings.join(keys, "term").select("k1", "k2", "item", "at", F.explode("places").alias("place"))
        .select("k1", "k2", "item", F.struct("at", (F.col("place") - F.col("at")).alias("shift")).alias("seen"))
    )
    wide = max(1, 2 * slop)
    cells = shifted.select(
        "k1", "k2", "item", "seen",
        F.explode(F.array(
            F.struct(F.lit(0).alias("grid"), F.floor(F.col("seen.shift") / wide).alias("cell")),
            F.struct(F.lit(1).alias("grid"), F.floor((F.col("seen.shift") + slop) / wide).alias("cell")),
        )).alias("c"),
    )
    met = cells.groupBy("k1", "k2", "item", "c").agg(F.collect_set("seen").alias("seen")).join(windows, "item")

    def pairs(window_of, matches):
        return F.filter("seen", lambda x: (x["at"] == window_of["a"]) & F.exists("seen", lambda y: (y["at"] == window_of["b"]) & matches(x, y)))

    exact = F.flatten(F.transform("windows", lambda w: F.transform(
        pairs(w, lambda x, y: x["shift"] == y["shift"]), lambda x: F.struct(w["start"].alias("start"), w["length"].alias("length"), x["shift"].alias("shift")),
    )))
    near = F.exists("windows", lambda w: F.size(pairs(w, lambda x, y: F.abs(x["shift"] - y["shift"]) <= slop)) > 0)
    met = written(
        met.select("k1", "k2", "item", near.alias("near"), F.when(F.col("c.grid") == 0, exact).alias("exact"))
        .filter("near or size(exact) > 0"),
        "matches",
    )
    found = (
        met.filter("exact is not null").select("k1", "k2", "item", F.explode("exact").alias("e"))
        .join(listed, "item")
        .groupBy("k1", "k2").agg(F.collect_list(F.struct(
            "item_id", (F.col("e.shift") + F.col("e.start")).alias("start"), F.slice("terms", F.col("e.start") + 1, F.col("e.length")).alias("terms"),
        )).alias("found"))
    )
    nearby = (
        met.filter("near").select("k1", "k2", "item").distinct().join(listed.select("item", "item_id"), "item")
        .groupBy("k1", "k2").agg(F.count_distinct("item_id").alias("n_near"))
    )
    matched = nearby.join(found, ["k1", "k2"], "left")
    return (
        rows.join(matched, ["k1", "k2"], "left")
        .select("doc_id", "text", "found", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
        .mapInArrow(_verified, _schema(docs, id_col))
    )


def _schema(docs: DataFrame, id_col: str) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return f"doc_id {kind}, n_words long, n_hit long, items array<string>, items_sha256 string, n_near long"


def _blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The distinct terms in parts of BLOCK_TERMS at most on average, one part on the driver at a time."""
    n = terms.count()
    parts = -(-n // BLOCK_TERMS)
    for k in range(parts):
        block = terms.filter(F.pmod("term", F.lit(parts)) == k).toArrow().column("term").combine_chunks()
        if len(block):
            yield block.to_numpy(zero_copy_only=False)
