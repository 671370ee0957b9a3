"""Keeping further columns out of the way of working columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but ``needed`` under names that clash with nothing, and a function that undoes it.

    The function selects the original columns in their order, and any further ones it is given.
    """
    names = {c: c if c in needed else f"__own_{k}" for k, c in enumerate(df.columns)}

    def restore(changed: DataFrame, *more: str) -> DataFrame:
        return changed.select(*(F.col(v).alias(k) for k, v in names.items()), *more)

    return df.select(*(F.col(f"`{k}`").alias(v) for k, v in names.items())), restore


#: Texts may be long: at 10,000 rows, Spark's default, a batch of them takes tens of MB in each Python worker, and far more where
#: documents are books. A batch holds so many rows or bytes at most (one row at least).
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to ROWS_PER_BATCH rows and BYTES_PER_BATCH bytes.

    Spark has no such limit for one query, so the session's is lowered; a lower one that is set already stays.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df
