"""Hard-negative mining in a multiway tree of split points with distance ranges between siblings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import written
from tidewait.llm.vectors import CHUNK, LEAST, MOST, best, blocks_of, first_members, folded, integer_vectors, longs, matrix, products

SAMPLE, WAYS, LEAF = 2048, 16, 64  # rows the split points are chosen from, split points of a node, sample rows of a leaf
ROWS, QUERIES = 1 << 14, 1 << 11  # of one group: rows of a bucket of leaves, and anchors that search it
SLACK = 1e-5


class Node(NamedTuple):
    """points: one split point a row; children: the node below each, or -1 - leaf."""

    points: np.ndarray
    children: list[int]


class Tree(NamedTuple):
    """dims: components; reach: the greatest squared length of a row; low, high: per node, distances of split point i to
    the rows below its sibling j."""

    dims: int
    reach: float
    nodes: list[Node]
    n_leaves: int
    low: list[np.ndarray]
    high: list[np.ndarray]


def lifted(v: np.ndarray, reach: float) -> np.ndarray:
    """One component more, so that all rows have the same length: their distance to an anchor then falls as the score grows."""
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(reach - (v * v).sum(axis=1), 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def planted(sample: np.ndarray, ways: int = WAYS, leaf: int = LEAF) -> tuple[list[Node], int]:
    """The nodes of a tree over the sample, and its number of leaves. Split points lie as far from each other as can be
    (each next one is the row farthest from those chosen); a row belongs to the nearest."""
    nodes: list[Node] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        picks, near = [], np.full(len(rows), np.inf)
        if len(rows) > leaf:
            at = int(np.argmax(_distances(rows, rows.mean(axis=0, keepdims=True))[:, 0]))
            while len(picks) < ways and near[at] > 0:
                picks.append(at)
                near = np.minimum(near, _distances(rows, rows[at : at + 1])[:, 0])
                near[picks] = 0
                at = int(np.argmax(near))
        if len(picks) < 2:
            leaves += 1
            return -leaves
        here, points = len(nodes), rows[picks]
        nodes.append(Node(points, []))
        owner = _distances(rows, points).argmin(axis=1)
        owner[picks] = np.arange(len(picks))
        nodes[here].children.extend(grow(rows[owner == j]) for j in range(len(picks)))
        return here

    grow(sample)
    return nodes, leaves


def descended(tree: Tree, x: np.ndarray, visit: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """The leaf of every row. visit is told a node, the distances of its rows to its split points, and the nearest."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        far = _distances(x[rows], tree.nodes[node].points)
        owner = far.argmin(axis=1)
        if visit:
            visit(node, far, owner)
        for j, child in enumerate(tree.nodes[node].children):
            if child < 0:
                out[rows[owner == j]] = -1 - child
            else:
                todo.append((child, rows[owner == j]))
    return out


def surviving(tree: Tree, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """anchors x leaves: where a row at a distance within a window [near, far] of the anchor may be.

    Rows below sibling j lie within [low, high] of split point i, which lies d from the anchor; so they are at least
    d - high or low - d and at most d + high from it. A sibling that no window meets for some i is left out, with all below it."""
    out = np.zeros((len(anchors), tree.n_leaves), bool)
    slack = SLACK * (np.sqrt((anchors * anchors).sum(axis=1)) + np.sqrt(tree.reach) + 1)
    near, far = near - slack[:, None], far + slack[:, None]
    if not tree.nodes:
        out[:, 0] = (near <= far).any(axis=1)
        return out
    todo = [(0, np.arange(len(anchors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        d = _distances(anchors[rows], tree.nodes[node].points)[:, :, None]
        low, high = tree.low[node][None], tree.high[node][None]
        at_least = np.maximum(np.maximum(d - high, low - d), 0).max(axis=1)
        at_most = (d + high).min(axis=1)
        for j, child in enumerate(tree.nodes[node].children):
            if not np.isfinite(tree.low[node][0, j]):  # nothing is below it
                continue
            meets = ((near[rows] <= at_most[:, j, None]) & (far[rows] >= at_least[:, j, None])).any(axis=1)
            if child < 0:
                out[rows[meets], -1 - child] = True
            else:
                todo.append((child, rows[meets]))
    return out


def _leaves(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lifted(matrix(pa.chunked_array([batch.column("v")]), tree.dims), tree.reach)
            yield batch.append_column("leaf", pa.array(descended(tree, x)))

    return place


def _ranges(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and node, the least and greatest distance of each split point to the rows below each sibling."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(n.points), len(n.points)), np.inf) for n in tree.nodes]
        high = [np.full((len(n.points), len(n.points)), -np.inf) for n in tree.nodes]

        def visit(node: int, far: np.ndarray, owner: np.ndarray) -> None:
            for j in np.unique(owner):
                low[node][:, j] = np.minimum(low[node][:, j], far[owner == j].min(axis=0))
                high[node][:, j] = np.maximum(high[node][:, j], far[owner == j].max(axis=0))

        for batch in batches:
            descended(tree, lifted(matrix(pa.chunked_array([batch.column("v")]), tree.dims), tree.reach), visit)
        for node in range(len(tree.nodes)):
            i, j = np.nonzero(np.isfinite(low[node]))
            yield pa.record_batch([np.full(len(i), node), i, j, low[node][i, j], high[node][i, j]], ["node", "i", "j", "low", "high"])

    return measure


def indexed(classes: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree and the classes with their leaf. Split points come from the SAMPLE distinct vectors of the smallest hash;
    every row is placed in a leaf and widens the ranges above it. The tree has at most SAMPLE leaves, so it and its ranges
    are bounded and travel with the tasks."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dims, reach = classes.agg(F.max(F.size("v")), F.max(square)).first()
    dims, reach = dims or 1, (reach or 0.0) * (1 + 1e-9)
    picked = classes.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    sample = lifted(matrix(picked.column("v"), dims), reach)
    nodes, n_leaves = planted(sample)
    tree = Tree(dims, reach, nodes, n_leaves, [], [])
    measured = classes.select("v").mapInArrow(_ranges(tree), "node long, i long, j long, low double, high double")
    for n in nodes:
        tree.low.append(np.full((len(n.points), len(n.points)), np.inf))
        tree.high.append(np.full((len(n.points), len(n.points)), -np.inf))
    for r in measured.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r.node][r.i, r.j], tree.high[r.node][r.i, r.j] = r.low, r.high
    placed = classes.select("class", "label", "tie", "v").mapInArrow(_leaves(tree), "class long, label long, tie long, v array<long>, leaf long")
    return tree, written(placed, "negatives-leaves")


def _buckets(placed: DataFrame, n_leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of every leaf: leaves side by side share one up to ROWS rows, and a larger leaf
    is cut into several."""
    sizes = np.zeros(max(n_leaves, 1), np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    first, parts, bucket, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes):
        if filled and filled + n > ROWS:
            bucket, filled = bucket + 1, 0
        first[leaf], parts[leaf] = bucket, blocks_of(int(n), ROWS)
        bucket, filled = (bucket + parts[leaf], 0) if parts[leaf] > 1 else (bucket, filled + n)
    return first, parts


def _probes(tree: Tree, first: np.ndarray, parts: np.ndarray, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The buckets each anchor has to search for scores in its windows: (class, label, v, floors, ceilings, bucket).

    A window runs from low to high percent of a wanted score, both ends included; low = 0 means from the score upwards."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column("v")]), tree.dims)
            scores = batch.column("scores")
            wanted, ends = scores.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(scores.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            if low:  # exact: hundreds and what is left of them apart
                floors = wanted // 100 * low - (-(wanted % 100) * low) // 100
                ceilings = wanted // 100 * high + wanted % 100 * high // 100
            else:
                floors, ceilings = wanted, np.full(len(wanted), MOST)
            row = np.repeat(np.arange(len(v)), np.diff(ends))
            windows = int(np.diff(ends).max(initial=0))
            x = np.column_stack([v.astype(float), np.zeros(len(v))])
            squares = (x * x).sum(axis=1) + tree.reach
            near, far = np.full((len(v), max(windows, 1)), np.inf), np.full((len(v), max(windows, 1)), -np.inf)
            at = np.arange(len(row)) - ends[row]
            open_ = floors <= ceilings
            near[row[open_], at[open_]] = np.sqrt(np.maximum(squares[row] - 2 * ceilings.astype(float), 0))[open_]
            far[row[open_], at[open_]] = np.sqrt(np.maximum(squares[row] - 2 * floors.astype(float), 0))[open_]
            who, leaf = np.nonzero(surviving(tree, x, near, far))
            spread = np.repeat(np.arange(len(who)), parts[leaf])
            bucket = first[leaf][spread] + np.arange(len(spread)) - np.searchsorted(spread, spread)
            pairs = np.unique(np.column_stack([who[spread], bucket]), axis=0)
            limits = [pa.ListArray.from_arrays(ends.astype(np.int32), x) for x in (floors, ceilings)]
            whole = pa.record_batch([batch.column("class"), batch.column("label"), batch.column("v"), *limits], ["class", "label", "v", "floors", "ceilings"])
            for k in range(0, len(pairs), 4096):
                yield whole.take(pa.array(pairs[k : k + 4096, 0])).append_column("bucket", pa.array(pairs[k : k + 4096, 1]))

    return probe


def _scan(dims: int, same: bool, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The `most` first rows of a bucket in every window of every anchor that searches it, of the anchor's label or not."""

    def scan(rows: pa.Table, probes: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and probes.num_rows:
            b, c, tie, label = matrix(rows.column("v"), dims), longs(rows.column("class")), longs(rows.column("tie")), longs(rows.column("label"))
            a, q, own = matrix(probes.column("v"), dims), longs(probes.column("class")), longs(probes.column("label"))
            windows = probes.column("floors").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = int(windows.max(initial=0))
            floors, ceilings = matrix(probes.column("floors"), n), matrix(probes.column("ceilings"), n)
            for k in range(0, len(a), CHUNK):
                part = slice(k, k + CHUNK)
                scores, alike = products(a[part], b), (own[part, None] == label[None, :]) == same
                for w in range(n):
                    allowed = alike & (scores >= floors[part, w, None]) & (scores <= ceilings[part, w, None]) & (windows[part, None] > w)
                    i, j = best(scores, tie, most, allowed)
                    found.append((q[k + i], np.full(len(i), w, np.int64), c[j], scores[i, j], tie[j]))
        columns = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["anchor", "at", "class", "score", "tie"], columns, strict=True)))

    return scan


def _searched(placed: DataFrame, anchors: DataFrame, tree: Tree, buckets: tuple, percent: tuple[int, int], same: bool, most: int, label: str, at_home: bool = False) -> DataFrame:
    """(anchor, at, class, score): the first `most` classes in each window of every anchor (class, label, v, scores)."""
    first, parts = buckets
    starts, sizes = F.array(*map(F.lit, first.tolist())), F.array(*map(F.lit, parts.tolist()))
    kept = F.col("leaf").cast("int")
    own = F.get(starts, kept) + F.pmod(F.xxhash64("class"), F.get(sizes, kept))
    rows = placed.withColumn("bucket", own)
    if at_home:
        floors, ceilings = F.col("scores"), F.array(F.lit(MOST))
        homes = placed.select("class", own.alias("home"))
        probes = anchors.join(homes, "class").select("class", "label", "v", floors.alias("floors"), ceilings.alias("ceilings"), F.col("home").alias("bucket"))
    else:
        probes = anchors.select("class", "label", "v", "scores").mapInArrow(
            _probes(tree, first, parts, *percent), "class long, label long, v array<long>, floors array<long>, ceilings array<long>, bucket long"
        )
    wide = blocks_of(anchors.count(), QUERIES)
    probes = probes.withColumn("qblock", F.pmod(F.xxhash64("class"), F.lit(wide)))
    rows = rows.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    scanned = rows.groupBy("bucket", "qblock").cogroup(probes.groupBy("bucket", "qblock")).applyInArrow(
        _scan(tree.dims, same, most), "anchor long, at long, class long, score long, tie long"
    )
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "tie", "class")
    return written(scanned.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("anchor", "at", "class", "score"), label)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, per_pair: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Rows of another label that score nearly as high as a positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the exact inner product with the anchor (the nearest long where it
    passes one). Anchors are the rows is_anchor names. An anchor's positives are its first `positives` other rows of the same label,
    by falling score, ties by the smaller id, no id last. For each, the first `per_pair` rows of another label whose score is from
    `low` to `high` percent of the positive's, ends included, are returned in that order (none for a score below 0).

    Rows are lifted to one length by a further component, so that scores are distances. A multiway tree of split points, fitted
    on a bounded sample (indexed), stores for every two siblings the range of distances from the split point of one to all
    rows below the other. Windows of scores are annuli about the anchor; a sibling whose range meets no annulus is
    left out, and leaves that remain are searched exactly. Positives are sought first in the anchor's own leaf, whose last
    one bounds the search elsewhere. The sample decides speed alone.

    Rows without a label, with a null vector, or with a null or non-finite component take no part. Shorter vectors count as filled up
    with 0. Rows of equal id are rows of their own. Fewer rows than wanted are all returned; an empty table gives no rows. Other columns are not read.

    Plan: equal vectors of one label are one class with its first rows. Leaves are joined to, or cut into, buckets of about ROWS rows;
    anchors are copied to the buckets they search and meet them in groups of about QUERIES.
    """
    rows = integer_vectors(vectors.filter(label.isNotNull()), id_col, vector_col, scale, "negatives-rows", label=label.cast("long"), asks=F.coalesce(is_anchor, F.lit(False)))
    most = max(positives + 1, per_pair)
    classes = folded(rows, ["label"], most, "negatives-classes")
    asking = rows.filter("asks")
    anchors = written(asking.select("v", "label").distinct().join(classes.select("class", "v", "label"), ["v", "label"]), "negatives-anchors")
    tree, placed = indexed(classes)
    buckets = _buckets(placed, tree.n_leaves)

    nothing = F.array(F.lit(LEAST))
    home = _searched(placed, anchors.withColumn("scores", nothing), tree, buckets, (0, 100), True, positives + 1, "negatives-home", at_home=True)
    enough = home.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") > positives, F.col("least")).otherwise(F.lit(LEAST))
    bounded = anchors.join(enough.withColumnRenamed("anchor", "class"), "class").select("class", "label", "v", F.array(bound).alias("scores"))
    found = _searched(placed, written(bounded, "negatives-bounds"), tree, buckets, (0, 100), True, positives + 1, "negatives-positives")
    near = written(first_members(found, classes, ["anchor"], positives + 1).withColumnRenamed("anchor", "class"), "negatives-near")

    mine = asking.join(anchors, ["v", "label"]).join(near, "class")
    mine = mine.select(F.col("id").alias("anchor_id"), "class", F.explode(F.slice(F.filter("best", lambda b: b["row"] != F.col("row")), 1, positives)).alias("p"))
    mine = written(mine.select("anchor_id", "class", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")), "negatives-mine")
    windows = mine.groupBy("class").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    windows = written(anchors.join(windows, "class"), "negatives-windows")
    hits = _searched(placed, windows.select("class", "label", "v", "scores"), tree, buckets, (low, high), False, per_pair, "negatives-hits")
    listed = first_members(hits, classes, ["anchor", "at"], per_pair).withColumnRenamed("anchor", "class")
    listed = listed.join(windows.select("class", "scores"), "class").select("class", F.get("scores", F.col("at").cast("int")).alias("positive_score"), "best")
    out = mine.join(listed, ["class", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("best").alias("b"))
    return out.select("anchor_id", "positive_id", F.col("b.rank").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
