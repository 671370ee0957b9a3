"""Readers of landed files: event feeds, order documents, bulk exports, address ranges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schemas import RAW_EVENTS, RAW_ORDERS

#: A feed file is named <tenant>-<yyyymmddhh>.ndjson, or lies in a folder hour=<yyyymmddhh>.
FEED_HOUR = r"(?:-|hour=)(\d{10})(?:\.ndjson$|/)"
#: What names a file: also the folder of its hour, as files of several folders may be called alike.
FEED_FILE = r"((?:hour=\d{10}/)?[^/]*)$"


def _with_file(raw: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select("*", F.regexp_extract(path, FEED_FILE, 1).alias("_file"), F.regexp_extract(path, FEED_HOUR, 1).alias("_hour"), path.alias("_path"))


def _reader(spark: SparkSession):
    """Lines as they are typed on arrival; undecodable ones keep their text in ``_corrupt``."""
    return spark.read.schema(RAW_EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")


def read_feed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of named feed files."""
    return _with_file(_reader(spark).json(paths))


def _closed_files(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """``path, hour`` of the feed's files of closed hours, from a listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.withColumn("hour", F.regexp_extract("path", FEED_HOUR, 1)).where((F.col("hour") != "") & (F.col("hour") < now.strftime("%Y%m%d%H")))


def src_event_feed(spark: SparkSession, path: str, now: datetime, max_files: int | None = None) -> DataFrame:
    """Lines of closed hours (named before the current UTC hour); undecodable lines keep their text in ``_corrupt``.

    ``max_files`` takes only the oldest ones, by a listing of names.
    """
    if max_files is not None:
        oldest = _closed_files(spark, path, now).orderBy("hour", F.regexp_extract("path", FEED_FILE, 1)).limit(max_files)
        names = [r["path"] for r in oldest.select("path").collect()]  # at most max_files
        return read_feed_files(spark, names) if names else _with_file(_reader(spark).option("recursiveFileLookup", True).json(path)).limit(0)
    raw = _reader(spark).option("recursiveFileLookup", True).json(path)
    return _with_file(raw).where((F.col("_hour") != "") & (F.col("_hour") < now.strftime("%Y%m%d%H")))


def closed_units(spark: SparkSession, path: str, now: datetime, since: str = "") -> list[str]:
    """Glob patterns, relative to ``path``, of its feed files of closed hours (from ``since`` on): one per folder and hour.

    Listed by Spark, so any store it reads will do.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    unit = F.regexp_replace(F.regexp_replace("path", r"/[^/]*-(\d{10}\.ndjson)$", "/*-$1"), r"(/hour=\d{10})/.*$", "$1/*")
    units = _closed_files(spark, path, now).where(F.col("hour") >= since).select("hour", unit.alias("unit")).distinct().orderBy("hour", "unit")
    # schemes are written with one slash or three
    tail = lambda text: text.split(":", 1)[-1].replace("//", "/").replace("//", "/")
    return [tail(r["unit"])[len(tail(base)) + 1 :] for r in units.toLocalIterator()]


def stream_event_feed(spark: SparkSession, path: str, now: datetime, max_files: int = 200, since: str = "") -> DataFrame:
    """The feed's hours that are closed at ``now``, as a stream; the checkpoint takes the place of moving files away.

    A file source never reads a file again, so one that lines may still be appended to must not be offered: each run
    offers the hours that are closed when it starts, from ``since`` (``yyyymmddhh``) on.
    """
    units = closed_units(spark, path, now, since)
    offered = f"{path}/{{{','.join(units)}}}" if units else f"{path}/none-closed-*"
    raw = (
        spark.readStream.schema(RAW_EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", max_files).json(offered)
    )
    return _with_file(raw)


def src_orders_feed(spark: SparkSession, path: str) -> DataFrame:
    """Order documents, one a line, nested as the platform gives them."""
    return spark.read.schema(RAW_ORDERS).json(path)


def src_bulk_export(spark: SparkSession, path: str, parent_schema: str, child_schema: str, children: str = "children") -> DataFrame:
    """A bulk export whose children are lines of their own: parents with ``children`` collected, null-free.

    Lines with ``__parentId`` are children. The join is on the parent's id, so a parent without children stays.
    """
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    parent_of = F.get_json_object("value", "$.__parentId")
    parents = lines.where(parent_of.isNull()).select(F.from_json("value", parent_schema).alias("p"), F.get_json_object("value", "$.id").alias("_id"))
    kids = lines.where(parent_of.isNotNull()).select(F.from_json("value", child_schema).alias("c"), parent_of.alias("_id"))
    grouped = kids.groupBy("_id").agg(F.collect_list("c").alias(children))
    return parents.join(grouped, "_id", "left").select("p.*", F.coalesce(children, F.array().cast(grouped.schema[children].dataType)).alias(children))


def src_geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Address ranges: ``ip_start, ip_end, country, region, city, lat, lon``."""
    return spark.read.parquet(path)
