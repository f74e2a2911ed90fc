"""Where the query modules register: name, Spark callable, oracle SQL (or none)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cuelake.plans.oracle import with_base
from cuelake.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship()
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times are UTC
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_base(sql)
        return fn
    return add
