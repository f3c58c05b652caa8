"""Registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bound import Bound
from checks.views import check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain_instants(df: DataFrame) -> DataFrame:
    """Instants leave as zone-less UTC, so no client zone can shift them."""
    stamps = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps}) if stamps else df


def oracles() -> dict[str, str]:
    """Each check with the CTEs it needs; resolved late, when every shape is known."""
    return {name: check_sql(text) for name, text in ORACLES.items()}


def query(name: str, sql: str | None = None):
    """Register a function of the bound tables under a name, with its check if it has one."""

    def register(fn: Callable[[Bound], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain_instants(fn(Bound(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
