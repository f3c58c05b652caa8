"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import word_array, written

BUCKETS = 1024  # rank ranges in which a source is put in order; a tuning figure that changes no result


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """totals (source, source_size, ...) with weight, cap and target.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; no target
    exceeds `most` times its source's size, and what is cut off goes to the others by weight until none is
    above. In the order of cap per weight the capped sources come first, so one running sum settles all of
    them. The table has one row per source and is ordered as a whole; documents never pass here.
    """
    everything = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights))
    so_far = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    capped = (
        ranked.withColumns({"weight": turn, "cap": F.lit(float(most)) * F.col("source_size")})
        .withColumns({
            "all_words": F.lit(float(share)) * F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(so_far), zero),
            "weight_before": F.coalesce(F.sum("weight").over(so_far), zero),
        })
        .withColumn(
            "capped",
            F.col("cap") * (F.col("all_weight") - F.col("weight_before"))
            <= (F.col("all_words") - F.col("cap_before")) * F.col("weight"),
        )
    )
    sums = capped.withColumns({
        "cap_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
        "weight_sum": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything),
    })
    free = F.col("weight") * (F.col("all_words") - F.col("cap_sum")) / (F.col("all_weight") - F.col("weight_sum"))
    return sums.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(free)).select(
        *totals.columns, "weight", "cap", "target"
    )


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def pareto_mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, tilt: float = 0.5,
    seed: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, expected, copies, taken.

    A document's expected copies are its source's ratio of target to size, tilted linearly in the bit length
    of its size (short texts a little above the ratio, long ones below, `tilt` of the room there is), so
    that sizes times expectations still add up to the target and none passes `most`. Whole copies are certain.
    What is left of the expectation is an inclusion probability p: documents are ranked by
    (u / (1-u)) / (p / (1-p)), u a hash of seed and id, and the ranked prefix whose words come nearest to what
    the certain copies leave open is taken once more. Fixed size thus means words, and a source misses
    its target by half of one document at most.

    Null or empty text: size 0, taken 0. Null sources form one source, last in order. Rows of equal id share
    u; equal rows are ranked side by side and any of them may be the last one taken. A source of size 0
    has target 0. Other columns are not read, whatever their names. Reruns agree.

    Plan: texts are read once for their sizes; the narrow rows are written. Totals are partial sums. No source is
    put in order as a whole: ranks fall into 1024 ranges by a formula that spreads them evenly, range
    sums give each range its start, and only rows of one (source, range) meet in a task.
    """
    size = F.size(word_array(F.col(text_col))).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = written(rows.withColumn("bits", F.length(F.bin("size")).cast("long")), "mix-rows")
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("bits")).alias("size_bits"),
        F.min("bits").alias("low"), F.max("bits").alias("high"),
    )
    targets = written(source_targets(totals, weights, share, most), "mix-targets")
    joined = _with(rows, targets, ["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("size_bits").cast("double") / F.col("source_size")).otherwise(F.lit(0.0))
    reach = F.greatest(F.col("mean") - F.col("low"), F.col("high") - F.col("mean"))
    room = F.least(F.col("ratio"), F.lit(float(most)) - F.col("ratio"))
    tilted = F.col("ratio") + F.lit(float(tilt)) * F.col("room") * (F.col("mean") - F.col("bits")) / F.col("reach")
    expected = (
        joined.withColumns({"ratio": ratio, "mean": mean}).withColumns({"reach": reach, "room": room})
        .withColumn("expected", F.when((F.col("reach") > 0) & (F.col("room") > 0), tilted).otherwise(F.col("ratio")))
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("part", F.col("expected") - F.col("certain"))
        .select("doc_id", "source", "size", "source_size", "target", "expected", "certain", "part")
    )
    left = written(
        expected.groupBy("source").agg(
            F.first("target").alias("goal"), F.sum(F.col("certain") * F.col("size")).alias("sure"),
            F.sum(F.col("part") * F.col("size")).alias("part_size"), F.sum(F.when(F.col("part") > 0, F.col("size"))).alias("part_of"),
        ).select("source", (F.col("goal") - F.col("sure")).alias("open"), (F.col("part_size") / F.col("part_of")).alias("typical")),
        "mix-left",
    )
    u = uniform(seed, F.col("doc_id"))
    odds = u / (F.lit(1.0) - u)
    ranked = (
        _with(expected, left, ["source"])
        .withColumn("rank", F.when(F.col("part") > 0, odds * ((F.lit(1.0) - F.col("part")) / F.col("part"))))
        .withColumn("even", F.col("rank") * F.col("typical") / (F.lit(1.0) - F.col("typical")))
        .withColumn("range", F.coalesce(F.floor(F.col("even") / (F.lit(1.0) + F.col("even")) * BUCKETS), F.lit(BUCKETS)).cast("int"))
        .drop("even", "typical")
    )
    sums = ranked.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = written(sums.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin")), "mix-ranges")
    inside = Window.partitionBy("source", "range").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("begin") + F.sum("size").over(inside)
    once_more = F.col("rank").isNotNull() & (F.lit(2) * F.col("until") - F.col("size") < F.lit(2.0) * F.col("open"))
    return (
        _with(ranked, begins, ["source", "range"]).withColumn("until", until)
        .withColumn("copies", F.col("certain") + once_more.cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "expected", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def _with(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Equality join in which null keys match."""
    other = more.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in more.columns])
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return rows.join(other, match, "left").drop(*[f"_{key}" for key in keys])
