"""History seeded from a hand-built CSV of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewait.functions.calendar import with_calendar
from tidewait.functions.claims import WAITED, axes_from_outcome
from tidewait.functions.clock import combine_local, hhmm_minutes
from tidewait.params import Params

# Every column is read as text, so a bad cell is refused by name instead of dropped.
CSV_SCHEMA = (
    "service_date STRING, origin STRING, depart_hhmm STRING, outcome STRING, "
    "peak_queue STRING, carryover STRING, source STRING"
)
IMPORTABLE = ("boarded", "waited_1", "waited_2plus", "cancelled")


def read_outcomes_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The file's columns by name, and `malformed`, the text of a line with too few or too many cells.

    The last three columns may be absent. `columns` states the file's columns in order; without it they are read off its header."""
    columns = columns or spark.read.option("header", True).csv(path).columns
    schema = ", ".join([*[f"`{c}` STRING" for c in columns], "`malformed` STRING"])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed", "columnPruning": False}
    raw = spark.read.schema(schema).options(**options).csv(path)
    wanted = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
    return raw.select(*[F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in wanted], "malformed")


def import_outcomes(rows: DataFrame, terminals: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(records, rejects). `filled` is refused: a hand-built file cannot know it. A malformed line is refused whole, whatever
    its cells would say."""
    malformed = F.col("malformed") if "malformed" in rows.columns else F.lit(None).cast("string")
    known = terminals.select(
        "route", F.col("terminal").alias("origin"), "destination"
    )
    trimmed = rows.select(
        *[F.trim(c).alias(c) for c in ("service_date", "origin", "depart_hhmm", "outcome")],
        F.col("peak_queue").try_cast("int").alias("peak_queue"),
        F.col("carryover").try_cast("int").alias("carryover"),
        "source", malformed.alias("malformed"),
    ).withColumn("_date", F.try_to_date("service_date", "yyyy-MM-dd"))
    judged = trimmed.join(known, "origin", "left").withColumn(
        "reason",
        F.when(F.col("malformed").isNotNull(), "wrong number of columns")
        .when(F.col("_date").isNull(), "bad date")
        .when(F.col("route").isNull(), "unknown terminal")
        .when(~F.coalesce(F.col("outcome").isin(*IMPORTABLE), F.lit(False)), "unknown outcome")
        .when(hhmm_minutes(F.col("depart_hhmm")).isNull(), "bad time"),
    )
    filled, left = axes_from_outcome(F.col("outcome"))
    accepted = with_calendar(
        judged.filter(F.col("reason").isNull()).withColumn("service_date", F.col("_date"))
    )
    records = accepted.select(
        "route", "origin", "destination", "service_date", "depart_hhmm",
        combine_local(F.col("service_date"), F.col("depart_hhmm"), params.zone).alias("scheduled"),
        "day_type", "season", "outcome", filled.alias("filled"), left.alias("left_behind"),
        (F.col("outcome") == "cancelled").alias("cancelled"),
        F.col("outcome").isin(*WAITED).alias("overload"), "peak_queue", "carryover",
        F.lit(0).cast("bigint").alias("n_frames"),
        F.concat(F.lit("import:"), F.coalesce("source", F.lit("manual"))).alias("method"),
    )
    rejects = judged.filter(F.col("reason").isNotNull()).select(
        "service_date", "origin", "depart_hhmm", "outcome", "reason", "malformed"
    )
    return records, rejects
