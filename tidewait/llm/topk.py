"""Exact top-k search by a three-phase uniform threshold over slices of the components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import written
from tidewait.llm.vectors import CHUNK, LEAST, best, blocks_of, first_members, folded, integer_vectors, longs, matrix, products

ROWS, QUERIES = 1 << 14, 1 << 12  # of one block: rows and queries that meet in one group
ENTRIES = "query long, slice int, classes array<long>, scores array<long>"


def _met(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Rows and queries dealt to (block, qblock): each row is copied to every block of queries and each query to every
    block of rows, so that every pair meets once, in a group of bounded size."""
    by, wide = blocks_of(n_rows, ROWS), blocks_of(n_queries, QUERIES)
    own, asked = F.pmod(F.xxhash64("class"), F.lit(by)).cast("int"), F.pmod(F.xxhash64("class"), F.lit(wide)).cast("int")
    left = rows.select("class", "tie", "v", F.lit(None).cast("long").alias("cutoff"), F.lit(False).alias("asks"), own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("qblock"))
    right = queries.select("class", F.lit(0).cast("long").alias("tie"), "v", "cutoff", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(by - 1))).alias("block"), asked.alias("qblock"))
    return left.unionByName(right)


def _sliced(met: DataFrame, slices: int, width: int) -> DataFrame:
    """Each list holds its own slice of the components, and nothing of the others."""
    return met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("v", F.slice("v", F.col("slice") * width + 1, F.lit(width)))


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    asks = table.column("asks")
    return table.filter(asks), table.filter(pa.compute.invert(asks))


def _scored(queries: pa.Table, rows: pa.Table, width: int):
    """(first query, scores of a chunk of queries with all rows) one chunk after the other."""
    a, b = matrix(queries.column("v"), width), matrix(rows.column("v"), width)
    for k in range(0, len(a), CHUNK):
        yield k, products(a[k : k + CHUNK], b)


def _gather(width: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Phase one at one list: the highest local scores of every query."""

    def gather(table: pa.Table) -> pa.Table:
        queries, rows = _split(table)
        q, c, tie, found = longs(queries.column("class")), longs(rows.column("class")), longs(rows.column("tie")), []
        for k, scores in _scored(queries, rows, width) if len(q) and len(c) else ():
            i, j = best(scores, tie, most)
            found.append((q[k + i], c[j], scores[i, j]))
        where = table.column("slice")[0].as_py() if len(table) else 0
        query, row, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"query": query, "slice": np.full(len(query), where, np.int32), "class": row, "local": score})

    return gather


def _collect(width: int) -> Callable[[pa.Table], pa.Table]:
    """Phase two at one list: every entry that reaches the query's cutoff; without one, all. A row for a query's entries."""

    def collect(table: pa.Table) -> pa.Table:
        queries, rows = _split(table)
        q, c = longs(queries.column("class")), longs(rows.column("class"))
        cutoff = longs(queries.column("cutoff").fill_null(LEAST))
        ends, classes, found = [np.zeros(1, np.int64)], [], []
        for k, scores in _scored(queries, rows, width) if len(q) and len(c) else ():
            i, j = np.nonzero(scores >= cutoff[k : k + CHUNK, None])
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(i, minlength=len(scores))))
            classes.append(c[j])
            found.append(scores[i, j])
        ends = np.concatenate(ends).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (classes, found)]
        n, where = len(ends) - 1, table.column("slice")[0].as_py() if len(table) else 0
        return pa.table({"query": q[:n], "slice": np.full(n, where, np.int32), "classes": lists[0], "scores": lists[1], "block": np.full(n, table.column("block")[0].as_py() if len(table) else 0, np.int32), "qblock": np.full(n, table.column("qblock")[0].as_py() if len(table) else 0, np.int32)})

    return collect


def _resolve(width: int, slices: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Phase three: sums of the entries that all lists sent, bounds for the others, and exact scores of those still open.

    A list that sent nothing of a row has less than its cutoff, so what was sent plus the cutoffs less one of the silent
    lists bounds the row. The k-th best complete sum raises what has to be reached."""

    def resolve(entries: pa.Table, table: pa.Table) -> pa.Table:
        queries, rows = _split(table)
        c, tie = longs(rows.column("class")), longs(rows.column("tie"))
        place, vectors = np.argsort(c), matrix(rows.column("v"), width)
        out, q = [], longs(queries.column("class"))
        asked = matrix(queries.column("v"), width)
        cutoff, where = dict(zip(q.tolist(), queries.column("cutoff").to_pylist(), strict=True)), dict(zip(q.tolist(), range(len(q)), strict=True))
        sent: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for query, classes, scores in zip(entries.column("query").to_pylist(), entries.column("classes"), entries.column("scores"), strict=True):
            sent.setdefault(query, []).append((classes.values.to_numpy(), scores.values.to_numpy()))
        for query, lists in sent.items():
            seen, at = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
            if not len(seen):
                continue
            at = at.reshape(-1)
            n_sent = np.bincount(at, minlength=len(seen))
            if cutoff[query] is not None:
                part = np.zeros(len(seen))
                np.add.at(part, at, np.concatenate([x[1] for x in lists]).astype(float))
                whole = np.sort(part[n_sent == slices])
                reach = max(float(cutoff[query] - 1) * slices, whole[-most] if len(whole) >= most else -np.inf)
                slack = 1e-9 * (np.abs(part) + abs(reach)) + slices  # sums of floating point; the exact score decides below
                keep = part + (slices - n_sent) * float(cutoff[query]) + slack >= reach
                seen = seen[keep]
            j = place[np.searchsorted(c[place], seen)]
            scores = products(asked[where[query]][None, :], vectors[j])
            _, k = best(scores, tie[j], most)
            out.append((np.full(len(k), query), seen[k], scores[0, k], tie[j][k]))
        query, row, score, ties = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"query": query, "class": row, "score": score, "tie": ties})

    return resolve


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, slices: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per query row and rank: query_id, rank, vec_id, score, the k other rows of the highest inner product.

    Components become floor(scale * x); scores are exact integers (the nearest long where they pass one). Ties go to the
    smaller id, no id last. Rows that is_query names are the queries; all rows, the query's own excepted, are candidates.

    The components are cut into `slices` lists. Phase one gathers the best local scores of each list; the rows in them are
    scored in full, and the k-th best is the threshold. A row that reaches it has at least its even share in some list: phase two
    sends every query that share, rounded up, as its cutoff and collects all entries at or above it. Phase three sums entries,
    drops rows whose bound stays below what is reached already, and scores the rest exactly.

    Null vectors and vectors with a null or non-finite component take no part. Shorter vectors count as filled up with 0.
    Rows of equal id are rows of their own, each a candidate of the other. A query with fewer than k candidates gets all of them; an
    empty table gives no rows. Other columns are not read. Huge components are handled by slower, exact arithmetic.

    Plan: equal vectors are one class with its k + 1 first rows, so copies cost one row whatever their number, and the
    search is for k + 1 rows with the query's own taken out afterwards. Rows and queries meet in groups of at most about ROWS by
    QUERIES; entries travel as arrays, one row per query, list and block. Results are exact for every block size.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale, "topk-rows", asks=F.coalesce(is_query, F.lit(False)))
    most = k + 1
    classes = folded(rows, [], most, "topk-classes")
    asking = rows.filter("asks")
    queries = written(asking.select("v").distinct().join(classes.select("class", "v"), "v"), "topk-queries")
    n_rows, n_queries = classes.count(), queries.count()
    dims = classes.agg(F.max(F.size("v"))).first()[0] or 1
    width = max(1, -(-dims // slices))

    met = _sliced(_met(classes, queries.withColumn("cutoff", F.lit(None).cast("long")), n_rows, n_queries), slices, width)
    local = met.groupBy("slice", "block", "qblock").applyInArrow(_gather(width, most), "query long, slice int, class long, local long")
    top = Window.partitionBy("query", "slice").orderBy(F.desc("local"), "class")
    listed = local.withColumn("_at", F.row_number().over(top)).filter(F.col("_at") <= most).select("query", "class").distinct()
    terms = F.zip_with("a", "v", lambda x, y: F.try_multiply(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))
    total = F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: F.try_add(s, x))
    scored = listed.join(queries.select(F.col("class").alias("query"), F.col("v").alias("a")), "query").join(classes.select("class", "v"), "class")
    ranked = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "class")
    scored = scored.select("query", "class", total.alias("score")).withColumn("_at", F.row_number().over(ranked)).filter(F.col("_at") == most)
    # The even share, rounded up: -floor(-score / slices).
    share = F.expr(f"(score - pmod(score, {slices})) div {slices}") + (F.expr(f"pmod(score, {slices})") > 0).cast("long")
    reached = queries.join(scored.select(F.col("query").alias("class"), share.alias("cutoff")), "class", "left")
    reached = written(reached, "topk-cutoffs")

    met = _met(classes, reached, n_rows, n_queries)
    schema = f"{ENTRIES}, block int, qblock int"
    entries = _sliced(met, slices, width).groupBy("slice", "block", "qblock").applyInArrow(_collect(width), schema)
    entries = written(entries, "topk-entries")
    resolved = entries.groupBy("block", "qblock").cogroup(met.groupBy("block", "qblock")).applyInArrow(
        _resolve(dims, slices, most), "query long, class long, score long, tie long"
    )
    last = Window.partitionBy("query").orderBy(F.desc("score"), "tie", "class")
    found = resolved.withColumn("_at", F.row_number().over(last)).filter(F.col("_at") <= most).select("query", "class", "score")
    lists = first_members(found, classes, ["query"], most).withColumnRenamed("query", "class")
    lists = lists.join(queries, "class").select("v", "best")
    mine = asking.join(lists, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["row"] != F.col("row")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score")
    )
