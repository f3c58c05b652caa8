"""Connected components by contraction: hook every label to its least neighbour, relabel, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of 64-bit ids that carry no order of their own -> (node, root), one row for each id in a link.

    Each round every label moves to the least of itself and its neighbours, four steps along these pointers, and the
    links are relabelled and made distinct; what is linked stays linked, and links inside one label go. Labels fall
    by about two thirds a round on chains of random ids and faster elsewhere. Every round is written, so
    plans stay short and a lost executor costs one round.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "component-links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hook = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("v")), "component-hooks")
        for _ in range(2):
            nxt = hook.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
            hook = hook.join(nxt, F.col("v") == F.col("_u")).select("u", F.col("_v").alias("v"))
        hook = written(hook, "component-pointers")
        rounds.append(hook)
        left = edges.join(hook.select(F.col("u").alias("a"), F.col("v").alias("va")), "a").join(hook.select(F.col("u").alias("b"), F.col("v").alias("vb")), "b")
        left = left.filter("va <> vb").select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).distinct()
        edges = written(left, "component-links")
    if not rounds:
        return links.sparkSession.createDataFrame([], "node long, root long")
    found = rounds[0].select(F.col("u").alias("node"), F.col("v").alias("root"))
    for hook in rounds[1:]:
        found = found.join(hook, F.col("root") == F.col("u"), "left").select("node", F.coalesce("v", "root").alias("root"))
    return found
