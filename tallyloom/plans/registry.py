"""Where queries register themselves with their oracle SQL.

Dates leave the registered queries as ISO text: engines disagree on how a date becomes a Python value, not on its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, dates: tuple[str, ...] = ("stat_date",)) -> Callable[[Query], Query]:
    """Register a function; ``dates`` are the date columns of its result. The function itself stays as it is."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[name] = run if dates else function
        if oracle is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({texts}) FROM (\n{oracle}\n)" if dates else oracle
        return function

    return register
