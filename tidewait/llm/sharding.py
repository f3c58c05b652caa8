"""Sharding by extendible hashing: only buckets above the byte limit split on another hash bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewait.llm.common import written

HASH_BITS = 60
STEP = 9  # bits looked ahead in one pass; a tuning figure that changes no result


def assign_shards(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard, depth, shard_docs, shard_bytes, over_limit.

    The directory starts with the number of hash bits that total bytes need at least; a bucket above
    max_bytes splits on the next bit, the others stay as they are. A shard's name is its hash prefix in bits.
    The hash covers id and text, so copies under other ids spread.

    Null or empty text: 0 bytes. Null ids are hashed as such. A bucket whose rows all have one hash (a single
    document above the limit, or one row repeated) can't split: it stays a shard, marked over_limit.
    Other columns are not read, whatever their names. An empty table gives an empty result.

    Plan: the texts are read once; the narrow rows (id, bytes, hash) are written. Bytes are summed over a prefix
    nine bits longer than the directory's and from these sums over every shorter prefix, so all splits
    of nine levels cost one aggregation with partial sums; the rare bucket that needs more goes round
    again with its own rows alone.
    """
    digest = F.md5(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))
    ))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low = min(HASH_BITS, max(0, (total // max_bytes).bit_length() - 1))
    found: DataFrame | None = None
    while True:
        high = min(HASH_BITS, low + STEP)
        rows = rows.withColumn("leaf", F.shiftright("hash", HASH_BITS - high))
        leaves = written(_directory(rows, low, high, max_bytes), "shard-directory")
        placed = rows.join(leaves, "leaf").drop("leaf")
        done = placed.filter("depth is not null").select(
            "doc_id", "n_bytes",
            F.concat(F.lit("s"), F.when(F.col("depth") > 0, F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0"))).otherwise("")).alias("shard"),
            "depth", "shard_docs", "shard_bytes", (F.col("shard_bytes") > max_bytes).alias("over_limit"),
        )
        found = done if found is None else found.unionByName(done)
        if leaves.filter("depth is null").isEmpty():
            return found
        rows = written(placed.filter("depth is null").select("doc_id", "n_bytes", "hash"), "shard-rows")
        low = high + 1


def _directory(rows: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """For each prefix of `high` bits the shortest prefix of `low` bits or more that need not split;
    depth is null where a longer prefix is needed."""
    leaves = rows.groupBy("leaf").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"), F.min("hash").alias("least"), F.max("hash").alias("most")
    )
    levels = leaves.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(leaf, {high} - depth)"))
    fits = (
        levels.groupBy("depth", "bucket")
        .agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"),
            F.min("least").alias("least"), F.max("most").alias("most"),
        )
        .filter((F.col("shard_bytes") <= max_bytes) | (F.col("least") == F.col("most")))
        .select("depth", "bucket", "shard_bytes", "shard_docs")
    )
    chosen = (
        levels.select("leaf", "depth", "bucket").join(fits, ["depth", "bucket"])
        .groupBy("leaf").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_docs"), "depth").alias("s"))
        .select("leaf", "s.*")
    )
    return leaves.select("leaf").join(chosen, "leaf", "left")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet, one folder per shard. Ids must be unique and not null here; a shard
    is at most its byte limit, so the task that writes it holds no more than that at a time."""
    placed = docs.join(shards.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard")), F.col(id_col) == F.col("_id")).drop("_id")
    placed.withColumnRenamed("_shard", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
