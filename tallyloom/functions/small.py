"""Small tables from Python rows, as local relations: no job to read them, and Catalyst knows their size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: Iterable[Sequence], ddl: str | StructType) -> DataFrame:
    """``rows`` under a schema; naive timestamps are UTC."""
    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)
    rows = list(rows)
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
