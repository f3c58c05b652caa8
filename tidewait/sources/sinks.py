"""Exports, keyed appends and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewait.functions.clock import iso_text
from tidewait.sources.tables import fresh_dir


def as_text(df: DataFrame) -> DataFrame:
    """Instants as stored text, so bounds compare the way text compares."""
    stamps = {n for n, t in df.dtypes if t == "timestamp"}
    return df.select(*[iso_text(F.col(c)).alias(c) if c in stamps else F.col(c) for c in df.columns])


def bounded(df: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """Inclusive bounds on the column's text. A bare date as `until` on a timestamp column
    therefore leaves that whole day out."""
    text = F.col(column).cast("string")
    if since:
        df = df.filter(text >= since)
    if until:
        df = df.filter(text <= until)
    return df


# Which column bounds and which orders each dataset.
DATASETS = {
    "frames": ("captured_at", "captured_at"),
    "services": ("service_date", "scheduled"),
    "board": ("observed_at", "observed_at"),
    "reports": ("service_date", "service_date"),
}


def export_dataset(tables: dict[str, DataFrame], dataset: str, since: str | None = None,
                   until: str | None = None) -> DataFrame:
    """One of the four exports, as text, bounded and ordered."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; choose from {', '.join(DATASETS)}")
    if dataset == "frames":
        extra = [c for c in tables["readings"].columns if c not in tables["frames"].columns]
        df = tables["frames"].join(tables["readings"].select("frame_id", *extra), "frame_id", "left")
    elif dataset == "services":
        extra = [c for c in tables["records"].columns if c not in tables["services"].columns]
        df = tables["services"].join(tables["records"].select("service_id", *extra), "service_id", "left")
    else:
        df = tables[dataset]
    column, order = DATASETS[dataset]
    return bounded(as_text(df), column, since, until).orderBy(order)


def write_export(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; choose csv or json")


def _whole(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])


def stored_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A written table, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_rows(target: DataFrame | None, batch: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The rows of a batch a keyed table would store: first per key, none already held.

    A key with a NULL part equals nothing, itself included, so such rows all pass. The first
    per key is an arg-min, which merges before the shuffle however often one key repeats.
    """
    whole = _whole(key)
    rest = [c for c in batch.columns if c not in key]
    first = (
        batch.filter(whole)
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("row"))
        .select(*key, "row.*")
    )
    if target is not None:
        first = first.join(target.select(*key).distinct(), key, "left_anti")
    return first.select(*batch.columns).unionByName(batch.filter(~whole))


def insert_or_ignore(target: DataFrame, batch: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    return target.unionByName(new_rows(target, batch, key, arrival))


def append_new(path: str, batch: DataFrame, key: list[str], arrival: list[str]) -> int:
    """Append the rows of a batch that a keyed table would store, and return how many that were.

    The write counts its own rows as it goes (an observed metric), so neither the batch nor the table is
    read a second time for the count. Offering a batch again stores none of its keyed rows."""
    fresh = new_rows(stored_table(batch.sparkSession, path, batch.schema), batch, key, arrival)
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("stored")).write.mode("append").parquet(path)
    return seen.get["stored"]


def write_keyed(path: str, batch: DataFrame, key: list[str], arrival: list[str], update: list[str] | None = None,
                partition: str = "service_date") -> None:
    """Upsert a batch into a table partitioned by date; only partitions the batch touches are read and rewritten.

    A row of a known key takes its place whole, or, with `update`, only lends it those columns. Of several rows of one
    key in a batch the last by `arrival` wins; with `update` the first is stored and the last lends. A key with a NULL part
    equals nothing and is added. The key must decide the partition. The merged partitions are written aside first and
    then swapped in, each as a whole, so repeating a batch, after a failure too, leaves the table as one run does.
    """
    spark, columns = batch.sparkSession, batch.columns
    rest = [c for c in columns if c not in key]
    order = F.struct(*arrival)
    newest = batch.filter(_whole(key)).groupBy(*key).agg(
        F.min_by(F.struct(*rest), order).alias("first"), F.max_by(F.struct(*rest), order).alias("last")
    )
    stored = stored_table(spark, path, batch.schema)
    lone = batch.filter(~_whole(key))
    if stored is None:
        known, merged = None, lone
    else:
        dates = [r[0] for r in batch.select(partition).distinct().collect()]
        known = stored.filter(F.col(partition).isin([d for d in dates if d is not None]) | (F.col(partition).isNull() & F.lit(None in dates)))
        taken = update or rest
        lent = newest.select(*key, F.col("last").alias("_last"))
        hit = F.col("_last").isNotNull()
        kept = [F.when(hit, F.col("_last")[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in columns]
        merged = known.join(lent, key, "left").select(*kept).unionByName(lone)
    added = newest if known is None else newest.join(known.select(*key), key, "left_anti")
    whole = {c: F.col("last" if update is None or c in update else "first")[c].alias(c) for c in rest}
    merged = merged.unionByName(added.select(*[whole.get(c, F.col(c)) for c in columns]))
    aside = fresh_dir(spark, "upsert")
    merged.write.parquet(aside)
    overwrite_dates(spark.read.schema(batch.schema).parquet(aside), path, partition)


def upsert_services(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Known services take the batch's day_type and season and keep the rest; new ones are added."""
    key = ["route", "origin", "scheduled"]
    fresh = batch.select(*key, F.col("day_type").alias("_dt"), F.col("season").alias("_se"))
    updated = target.join(fresh, key, "left").withColumns(
        {"day_type": F.coalesce("_dt", "day_type"), "season": F.coalesce("_se", "season")}
    ).select(*target.columns)
    added = batch.join(target.select(*key), key, "left_anti").select(*target.columns)
    return updated.unionByName(added)


def insert_or_replace(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch win whole over rows of the same key."""
    return target.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)


def overwrite_dates(df: DataFrame, path: str, partition: str = "service_date") -> None:
    """Replace only the partitions present in df, all or none of each. A crowded partition is written by
    several tasks, each bounded in size."""
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
