"""Exact order statistics that never gather a group into one place.

Values here are small integers (minutes, counts, percentages), so a group is first reduced
to "value, how often" by an ordinary partially aggregated groupBy. What is left per group is
bounded by the value's domain, however many rows one key held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upper_median(column: str, where: str | None = None) -> Column:
    """sorted[n // 2] as an aggregate: the discrete median counted from the top."""
    value = f"CASE WHEN {where} THEN {column} END" if where else column
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def upper_median_of(values: Column) -> Column:
    """The same over a short array."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, F.floor(F.size(values) / 2).cast("int") + 1))


def value_counts(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """One row per key: n, max and each named nearest-rank percentile."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), keys, value)
    group = W.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumns(
        {"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)}
    )
    picks = [
        F.min(
            F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("total") - 1)), F.col(value))
        ).alias(name)
        for name, f in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), *picks, F.max(value).alias("max")
    )


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho per key with average ranks; NULL under three rows or on a flat series.

    Ranks come from the joint counts of (x, y), so repeated pairs are one row.
    """
    cells = value_counts(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, y)

    def average_rank(v: str) -> Column:
        below = F.sum("n").over(
            W.partitionBy(*keys).orderBy(v).rangeBetween(W.unboundedPreceding, W.currentRow)
        )
        peers = F.sum("n").over(W.partitionBy(*keys, v))
        return below - peers + (peers + 1) / 2

    # The sums are windows over the keys and not a grouping: the rows lie in their order already, so each key is summed
    # as it passes by, where a grouping would hold every key of a task twice.
    by_x = cells.select(*keys, y, "n", average_rank(x).alias("rx"))
    ranked = by_x.select(*keys, y, "n", "rx", average_rank(y).alias("ry"))
    group = W.partitionBy(*keys)
    total = lambda c: F.sum(F.col("n") * c).over(group)
    rx, ry = F.col("rx"), F.col("ry")
    summed = ranked.select(
        *keys, y, F.sum("n").over(group).alias("n"),
        total(rx).alias("sx"), total(ry).alias("sy"),
        total(rx * rx).alias("sxx"), total(ry * ry).alias("syy"), total(rx * ry).alias("sxy"),
    )
    sums = summed.withColumn("_row", F.row_number().over(group.orderBy(y))).filter(F.col("_row") == 1)
    n = F.col("n")
    dx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    dy = n * F.col("syy") - F.col("sy") * F.col("sy")
    num = n * F.col("sxy") - F.col("sx") * F.col("sy")
    return sums.select(
        *keys, "n",
        F.when((n >= 3) & (dx > 0) & (dy > 0), num / F.sqrt(dx * dy)).alias("rho"),
    )
