"""Numbering and running totals that never bring a whole group, or a whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallyloom.plans.lineage import cut_lineage

#: Rows of one identity whose places are listed together.
PEERS_AT_ONCE = 1024


def number_peers(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``peer``: 0, 1, 2, ... among the rows that agree in ``keys`` (by a 64-bit hash of them; null equals null).

    ``df`` must be materialised (its partitions must not change). Peers are numbered inside each partition, and the
    partitions' counts are added up, so a key of very many rows spreads over as many tasks as it has partitions.
    """
    row = F.monotonically_increasing_id()
    marked = df.withColumns({"__key": F.xxhash64(*keys), "__row": row}).withColumn("__part", F.shiftright("__row", 33))
    here = Window.partitionBy("__key", "__part")
    counts = marked.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # few rows: only keys of several partitions
    offsets = counts.select("__key", "__part", F.sum("__n").over(before).alias("__before")).where("__before > 0")
    numbered = marked.withColumn("__local", F.row_number().over(here.orderBy("__row")) - 1).join(offsets, ["__key", "__part"], "left")
    return numbered.select(*df.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long").alias("peer"))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name of ``totals``, the sum of that (integral) column over all rows before it in ``order``.

    ``order`` should tell rows apart: rows are dealt by ranges of it, summed inside each, and the ranges' sums added up.
    """
    dealt = df.withColumns({f"__{k}": v.cast("long") for k, v in totals.items()}).repartitionByRange(*order)
    dealt = cut_lineage(dealt.withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__all_{k}") for k in totals))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__all_{k}").over(ahead), F.lit(0)).alias(f"__ahead_{k}") for k in totals))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(parts), "__part").select(
        *df.columns, *((F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) + F.col(f"__ahead_{k}")).alias(k) for k in totals)
    )


def identity(df: DataFrame) -> dict[str, Column]:
    """``__k1, __k2``: two 64-bit hashes of all columns. Rows that agree in them are equal and stand for each other."""
    columns = [
        F.to_json(F.struct(f.name)) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f.name) for f in df.schema
    ]
    # an array of nulls tells null from a value that hashes alike
    nulls = [F.col(f.name).isNull() for f in df.schema]
    return {f"__k{k}": F.xxhash64(F.lit(k), *columns, *nulls) for k in (1, 2)}


def meet_places(rows: DataFrame, places: DataFrame, place: Column) -> DataFrame:
    """One copy of each row of ``rows`` (with ``__k1, __k2``) for every row of ``places`` (with them and ``peer``), as ``place``.

    Equal rows are one before the shuffle; the places of very frequent ones come in lists of bounded length.
    """
    keys = ["__k1", "__k2"]
    lists = places.groupBy(*keys, F.floor(F.col("peer") / PEERS_AT_ONCE)).agg(F.collect_list(place).alias("places"))
    return rows.dropDuplicates(keys).join(lists.select(*keys, "places"), keys).withColumn("place", F.explode("places"))
