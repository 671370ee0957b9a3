"""Writers: the event table and the rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by tenant and UTC date; rows of a partition are gathered first, so files stay large."""
    dated = events.withColumn("event_date", F.to_date("occurred_at"))
    spread = F.pmod(F.xxhash64("event_uid"), F.lit(16))  # a hot tenant's day is written by several tasks
    dated.repartition("tenant_id", "event_date", spread).write.mode(mode).partitionBy("tenant_id", "event_date").parquet(path)


def sink_rollup(rollup: DataFrame, path: str, keys: tuple[str, ...] = ("tenant_id", "stat_date")) -> None:
    """Replace exactly the partitions that ``rollup`` holds; running it again changes nothing."""
    rollup.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Order documents in a file: compressed files are read whole by one task.
FEED_DOCUMENTS = 100_000


def sink_orders_feed(documents: DataFrame, path: str) -> None:
    """Land order documents, one a line, as ``feeds.src_orders_feed`` reads them; compressed, as most of their text are names."""
    documents.write.option("compression", "gzip").option("maxRecordsPerFile", FEED_DOCUMENTS).json(path)
