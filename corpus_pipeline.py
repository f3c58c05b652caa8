"""The corpus pipeline: language, near duplicates, contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. Decisions are taken row by row, whatever the ids: operators are given a key of the row's whole
content instead of doc_id. Rows equal in every column are one document: they stay or go together, and the mixture takes
them as often as it takes them all in all. Columns must be of types that can be hashed (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewait.llm import decontaminate, jaccard, language, mixing, sharding
from tidewait.llm.common import row_key, written

SHARD_BYTES = 1 << 20
SMALL = 1 << 20


def _row(docs: DataFrame) -> Column:
    """128 bits of the whole row. Which columns are null is hashed too, as a null leaves a hash unchanged."""
    return F.struct(*row_key(*[F.col(f"`{c}`").isNull() for c in docs.columns], *[F.col(f"`{c}`") for c in docs.columns]))


def _only(docs: DataFrame, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose key is, or with left_anti is not, among the chosen (column row; others are added by inner).

    Up to SMALL keys (some 100 MB) are broadcast, so that no text moves; more of them are joined by shuffle."""
    side = chosen.select(F.col("row.k1").alias("_k1"), F.col("row.k2").alias("_k2"), *[c for c in chosen.columns if c != "row"])
    if side.count() <= SMALL:
        side = F.broadcast(side)
    match = (F.col("_row.k1") == F.col("_k1")) & (F.col("_row.k2") == F.col("_k2"))
    return docs.withColumn("_row", _row(docs)).join(side, match, how).drop("_row", "_k1", "_k2")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; text without a letter, or none, goes."""
    samples = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = written(language.identify(docs.withColumn("_id", _row(docs)), samples, id_col="_id"), "pipeline-language")
    return _only(docs, found.filter("lang_pred = 'und'").select(F.col("doc_id").alias("row")), "left_anti")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, null last; of rows of one id that
    of the smallest key."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), _row(docs).alias("row"))
    found = jaccard.near_duplicates(docs.withColumn("_id", place), id_col="_id")
    return _only(docs, written(found.filter("doc_id <=> component_id").select("doc_id.row").distinct(), "pipeline-first"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.withColumn("_id", _row(docs)), items, id_col="_id")
    return _only(docs, written(found.filter("n_hit > 0").select(F.col("doc_id").alias("row")), "pipeline-contaminated"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: each document as often as it is taken, once, twice or not at all.

    Of equal rows the last may be taken once more than the others, so one of them stands for all with their copies summed;
    only such rows move."""
    taken = mixing.pareto_mix(docs.withColumn("_id", _row(docs)), id_col="_id").groupBy(F.col("doc_id").alias("row"))
    taken = taken.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    taken = written(taken, "pipeline-mix")
    found = _only(docs, taken.filter("_rows = 1"), "inner")
    if not (equal := taken.filter("_rows > 1")).isEmpty():
        found = found.unionByName(_only(docs, equal, "inner").dropDuplicates())
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies", "_rows", "_copy")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row of the mixture."""
    return sharding.assign_shards(docs, SHARD_BYTES)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixture", mixed),
    ("shards", sharded),
]

# No SQL: the language stage is a trained model. tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
