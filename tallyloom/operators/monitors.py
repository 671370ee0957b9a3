"""Monitors over the pipeline's own tables. Findings share ``alert_key, severity, message``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.small import small_table
from tallyloom.sources.feeds import FEED_FILE, FEED_HOUR

# Hours after which a job without success is late.
JOB_HOURS = {"import": 2, "rollup": 3, "sync": 3, "identity": 3, "attribute": 3, "compliance": 48}


def mon_freshness(job_runs: DataFrame, now: datetime | str, hours: dict[str, int] | None = None) -> DataFrame:
    """Jobs whose last success is too old; critical beyond six times the limit. Jobs that never ran are skipped."""
    limits = small_table(job_runs.sparkSession, list((hours or JOB_HOURS).items()), "job STRING, limit_hours INT")
    last = job_runs.where("status = 'ok'").groupBy("job").agg(F.max("finished_at").alias("last_success"))
    age = F.lit(now).cast("timestamp").cast("long") - F.col("last_success").cast("long")
    late = last.join(F.broadcast(limits), "job").withColumn("hours", F.floor(age / 3600)).where(age > F.col("limit_hours") * 3600)
    return late.select(
        F.concat(F.lit("stale:"), "job").alias("alert_key"), F.when(age > F.col("limit_hours") * 3600 * 6, "critical").otherwise("warn").alias("severity"),
        F.concat("job", F.lit(" last succeeded "), F.col("hours").cast("string"), F.lit(" hours ago")).alias("message"),
    )


def mon_import_failures(import_log: DataFrame, now: datetime | str, hours: int = 6) -> DataFrame:
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    failed = import_log.where((F.col("status") == "failed") & (F.col("imported_at") >= since))
    sums = failed.agg(F.count("*").alias("files"), F.max("message").alias("message")).where("files > 0")
    return sums.select(F.lit("import:failed").alias("alert_key"), F.lit("warn").alias("severity"), F.concat(F.col("files").cast("string"), F.lit(" files failed: "), F.coalesce("message", F.lit(""))).alias("message"))


def mon_backlog(files: DataFrame, import_log: DataFrame, now: datetime | str, most: int = 500, minutes: int = 90) -> DataFrame:
    """Closed files without an import; ``files``: ``file_name, closed_at``."""
    waiting = files.join(import_log.where("status = 'ok'").select("file_name"), "file_name", "left_anti")
    sums = waiting.agg(F.count("*").alias("n"), F.min("closed_at").alias("oldest")).where("n > 0")
    age = F.floor((F.lit(now).cast("timestamp").cast("long") - F.col("oldest").cast("long")) / 60)
    severity = F.when(F.col("n") > most, "critical").when(age > minutes, "warn")
    out = sums.select(F.lit("import:backlog").alias("alert_key"), severity.alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" files wait, the oldest for "), age.cast("string"), F.lit(" minutes")).alias("message"))
    return out.where("severity is not null")


def mon_capacity(sizes: DataFrame, limit_bytes: int) -> DataFrame:
    """Partitions that near a limit; ``sizes``: ``partition_key, bytes``, one row a file."""
    used = sizes.groupBy("partition_key").agg(F.sum("bytes").alias("bytes")).withColumn("pct", F.round(F.col("bytes") / limit_bytes * 100, 1))
    severity = F.when(F.col("pct") >= 95, "critical").when(F.col("pct") >= 80, "warn")
    return used.where("pct >= 80").select(F.concat(F.lit("capacity:"), "partition_key").alias("alert_key"), severity.alias("severity"), F.format_string("%.1f%% used", "pct").alias("message"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, bytes, modified_at`` of all files below ``path``, from Spark's listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def feed_files(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """``file_name, closed_at, bytes`` of the feed files of closed hours: what ``mon_backlog`` takes."""
    hour = F.regexp_extract("file_path", FEED_HOUR, 1)
    closed = listed_files(spark, path).where((hour != "") & (hour < now.strftime("%Y%m%d%H")))
    return closed.select(F.regexp_extract("file_path", FEED_FILE, 1).alias("file_name"), F.col("modified_at").alias("closed_at"), "bytes")


def file_sizes(spark: SparkSession, path: str, partition_column: str) -> DataFrame:
    """``partition_key, bytes``, one row a file, of a table in folders of ``partition_column``: what ``mon_capacity`` takes."""
    files = listed_files(spark, path).withColumn("partition_key", F.regexp_extract("file_path", f"/{partition_column}=([^/]*)/", 1))
    return files.where("partition_key <> ''").select("partition_key", "bytes")


def mon_compliance(requests: DataFrame, now: datetime | str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    late = requests.where(F.col("completed_at").isNull() & (F.col("received_at") < at - F.expr("INTERVAL 24 HOURS")))
    by_topic = late.groupBy("topic").agg(F.count("*").alias("n"), F.min("received_at").alias("oldest"))
    critical = F.col("oldest") < at - F.expr("INTERVAL 48 HOURS")
    return by_topic.select(F.concat(F.lit("compliance:"), "topic").alias("alert_key"), F.when(critical, "critical").otherwise("warn").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" requests open")).alias("message"))


def mon_alert_state(state: DataFrame, findings: DataFrame, now: datetime | str, every_minutes: int = 360) -> DataFrame:
    """Fold findings into ``alert_key, severity, message, status, raise_count, first_raised_at, last_raised_at, notified_at, notify``.

    A finding raises or re-opens its alert, an absent one resolves it; a raised alert is told at most every ``every_minutes``.
    """
    at = F.lit(now).cast("timestamp")
    found = findings.select("alert_key", F.col("severity").alias("_severity"), F.col("message").alias("_message"), F.lit(True).alias("_found"))
    both = state.join(found, "alert_key", "full")
    raised, fresh = F.col("_found").isNotNull(), F.col("status").isNull() | (F.col("status") == "resolved")
    due = raised & (fresh | F.col("notified_at").isNull() | (F.col("notified_at") <= at - F.expr(f"INTERVAL {every_minutes} MINUTES")))
    return both.select(
        "alert_key", F.when(raised, F.col("_severity")).otherwise(F.col("severity")).alias("severity"), F.when(raised, F.col("_message")).otherwise(F.col("message")).alias("message"),
        F.when(raised, "open").otherwise("resolved").alias("status"),
        (F.coalesce("raise_count", F.lit(0)) + raised.cast("int")).alias("raise_count"),
        F.when(raised & fresh, at).otherwise(F.col("first_raised_at")).alias("first_raised_at"),
        F.when(raised, at).otherwise(F.col("last_raised_at")).alias("last_raised_at"),
        F.when(due, at).otherwise(F.col("notified_at")).alias("notified_at"), F.coalesce(due, F.lit(False)).alias("notify"),
    )
