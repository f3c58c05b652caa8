"""Fixed schemas of the base tables, and where working data lives."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "frames": """frame_id BIGINT, route STRING, terminal STRING, camera STRING, captured_at TIMESTAMP,
        service_date DATE, path STRING, sha256 STRING, bytes BIGINT, width INT, height INT,
        status STRING, error STRING""",
    "board": """row_id BIGINT, route STRING, terminal STRING, observed_at TIMESTAMP, service_date DATE,
        hhmm STRING, departed_hhmm STRING, percent_available INT, vessel STRING, status_text STRING,
        fetch_status STRING, error STRING, raw STRING""",
    "readings": """reading_id BIGINT, frame_id BIGINT, version STRING, model STRING, vehicle_count INT,
        lanes_occupied INT, beyond BOOLEAN, dock BOOLEAN, visibility STRING, band STRING,
        confidence DOUBLE, usable BOOLEAN, notes STRING, input_tokens BIGINT, output_tokens BIGINT,
        cost_usd DOUBLE, created_at TIMESTAMP, raw STRING""",
    "services": """service_id BIGINT, route STRING, origin STRING, destination STRING, service_date DATE,
        scheduled TIMESTAMP, depart_hhmm STRING, day_type STRING, season STRING""",
    "records": """service_id BIGINT, route STRING, origin STRING, service_date DATE, depart_hhmm STRING,
        outcome STRING, filled BOOLEAN, left_behind BOOLEAN, cancelled BOOLEAN, overload BOOLEAN,
        peak_queue INT, queue_at_departure INT, residual_queue INT, carryover INT, n_frames BIGINT,
        confidence DOUBLE, queue_truncated BOOLEAN, deck_space_min INT, method STRING,
        filled_at TIMESTAMP, peak_band STRING, band_at_departure STRING, residual_band STRING,
        queue_started_at TIMESTAMP, cleared_at TIMESTAMP, left_full BOOLEAN, departed_at TIMESTAMP,
        departed_source STRING""",
    "reports": """report_id BIGINT, route STRING, origin STRING, service_date DATE, depart_hhmm STRING,
        joined_at TIMESTAMP, departed_at TIMESTAMP, boarded BOOLEAN, sailings_waited INT,
        deck_fullness STRING, source STRING, submitted_at TIMESTAMP""",
    "forecasts": """route STRING, terminal STRING, site STRING, service_date DATE, issued_at TIMESTAMP,
        fetched_at TIMESTAMP, area STRING, location STRING, kind STRING, period STRING, wind STRING,
        visibility STRING, warning STRING, wind_max_kt INT, band STRING, fetch_status STRING,
        error STRING, raw STRING""",
    "shore_forecasts": """route STRING, terminal STRING, site STRING, service_date DATE,
        issued_at TIMESTAMP, fetched_at TIMESTAMP, station STRING, region STRING, kind STRING,
        period STRING, condition STRING, pop INT, temp_high INT, temp_low INT, summary STRING,
        fetch_status STRING, error STRING, raw STRING""",
    "tags": "service_date DATE, tag STRING, note STRING, source STRING, created_at TIMESTAMP",
    "positions": """row_id BIGINT, route STRING, vessel STRING, status STRING, heading STRING,
        speed_knots DOUBLE, reported_at TIMESTAMP, observed_at TIMESTAMP, fetch_status STRING,
        error STRING""",
}

# Tables written one directory per service date, so a date predicate prunes files.
PARTITIONED = ("frames", "board", "services", "records", "reports", "forecasts", "shore_forecasts")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table with its fixed schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates and stream checkpoints: the one named in
    spark.checkpoint.dir, or a folder of the warehouse, which all executors reach too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{label}-{os.urandom(6).hex()}"
