"""Deleting and changing stored rows by files: whole partitions by their names, else only the files that hold a hit."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.files import TableFiles

#: Files that are rewritten by one swap.
FILES_AT_ONCE = 1000


def purge_tenants(spark: SparkSession, table: str, due: DataFrame, swap: str) -> DataFrame:
    """Take the partitions of the ``due`` tenants (``tenant_id``) out of a table that is partitioned by tenant first.

    Returns ``tenant_id, rows_removed``. Only their files are opened, to be counted, and no file of another tenant is touched.
    """
    files = TableFiles(spark, table)
    files.recover()
    there = {n.partition("=")[2]: n for n in files.folder.names("") if n.startswith("tenant_id=")}
    gone = sorted(there[t] for t in {str(r["tenant_id"]) for r in due.select("tenant_id").distinct().toLocalIterator()} if t in there)
    if not gone:
        return spark.createDataFrame([], "tenant_id int, rows_removed bigint")
    rows = spark.read.option("basePath", files.folder.path).parquet(*(f"{files.folder.path}/{n}" for n in gone))
    counts = [tuple(r) for r in rows.groupBy("tenant_id").agg(F.count("*").alias("rows_removed")).collect()]  # a row a purged tenant
    files.commit(swap, gone)
    return spark.createDataFrame(counts, "tenant_id int, rows_removed bigint")


def rewrite_hits(spark: SparkSession, table: str, hits: DataFrame, on: list[str], change: Callable[[DataFrame], DataFrame], swap: str) -> int:
    """Rewrite the files that hold rows with the keys of ``hits`` (``on``), and only those; returns how many there were.

    ``change`` gets a file's rows with ``_hit`` and returns what is stored of them, without it. Files are swapped FILES_AT_ONCE at a time behind a
    journal: a crash leaves the old or the new files of each swap. Repeating an edit of rows that are changed already must do no harm.
    """
    files = TableFiles(spark, table)
    files.recover()
    if not files.folder.files(""):
        return 0
    keys = hits.select(*on).where(" and ".join(f"`{c}` is not null" for c in on)).distinct()
    named = spark.read.parquet(table).select(*on, F.col("_metadata.file_path").alias("_path"))
    found = named.join(keys, on, "left_semi").select("_path").distinct()
    paths = sorted(unquote(r["_path"]) for r in found.toLocalIterator())  # names only
    base = files.folder.path.split(":", 1)[-1].replace("//", "/").replace("//", "/")
    inside = [p.split(":", 1)[-1].replace("//", "/").replace("//", "/")[len(base) + 1 :] for p in paths]
    for k in range(0, len(paths), FILES_AT_ONCE):
        some, name = inside[k : k + FILES_AT_ONCE], f"{swap}-{k}"
        files.abandon(name)
        rows = spark.read.option("basePath", files.folder.path).parquet(*(f"{files.folder.path}/{p}" for p in some))
        marked = rows.join(keys.withColumn("_hit", F.lit(True)), on, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        parts = [d.split("=")[0] for d in some[0].split("/")[:-1]]
        changed = change(marked).select(*rows.columns)
        writer = (changed.repartition(*parts) if parts else changed).write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(files.staging(name))
        files.commit(name, some)
    return len(paths)


def delete_hits(spark: SparkSession, table: str, hits: DataFrame, on: list[str], swap: str) -> int:
    """Delete the rows with the keys of ``hits``."""
    return rewrite_hits(spark, table, hits, on, lambda rows: rows.where("not _hit"), swap)


def clear_hits(spark: SparkSession, table: str, hits: DataFrame, on: list[str], columns: tuple[str, ...], swap: str) -> int:
    """Set ``columns`` to null in the rows with the keys of ``hits``; a key that is cleared is found no more."""
    return rewrite_hits(spark, table, hits, on, lambda rows: rows.withColumns({c: F.when(~F.col("_hit"), F.col(c)) for c in columns}), swap)
