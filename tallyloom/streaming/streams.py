"""Structured Streaming forms of ingest, deduplication, rollups, sessions, order merge and rate limit."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import ingest, orders, rollups
from tallyloom.schemas import SESSION_GAP_SECONDS
from tallyloom.sources.feeds import read_feed_files, stream_event_feed
from tallyloom.sources.files import Folder, PartStore, TableFiles
from tallyloom.sources.sinks import sink_events, sink_rollup
from tallyloom.streaming.key_index import KeyIndex


def stream_dedup(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """One row per (tenant_id, event_uid) as long as its first is younger than ``delay``; state is bounded by that."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["tenant_id", "event_uid"])


def stream_rate_counts(batches: DataFrame, delay: str = "2 minutes", most: int = ingest.MAX_BATCHES_A_MINUTE) -> DataFrame:
    """Batches per address and UTC minute, with how many are over the limit."""
    counts = batches.withWatermark("received_at", delay).groupBy(F.window("received_at", "1 minute"), "ip").agg(F.count("*").alias("batches"))
    return counts.select(F.col("window.start").alias("minute"), "ip", "batches", F.greatest(F.lit(0), F.col("batches") - most).alias("dropped"))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What names a stream for good: a fresh checkpoint is another stream."""
    return json.loads(Folder(spark, checkpoint).read_text("metadata"))["id"]


#: Address-minutes are kept in so many parts an hour.
RATE_PARTS = 16


def stream_rate_limit(batches: DataFrame, path: str, checkpoint: str, most: int = ingest.MAX_BATCHES_A_MINUTE, memory_hours: int = 2) -> StreamingQuery:
    """Pass on the first ``most`` batches of each address and UTC minute, to be read by ``read_passed``; drop the others.

    How many batches a minute has had lies beside the output, so the limit holds across micro-batches and restarts. With
    batches that arrive in the order of their receive times the output is that of ``ingest_rate_limit``; in any other order
    as many pass, the ones that arrived first. Minutes are remembered for ``memory_hours`` after the newest one. Before they are
    shuffled, the rows of an address and minute are cut to ``most`` a task, so one address may send a third of all rows.
    """

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hour", "part", "minute", "ip").agg(F.sum("seen").alias("seen"))

    def gate(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit = f"{_stream_id(spark, checkpoint)}-{number}"
        counts = PartStore(spark, f"{path}/counts", ("hour", "part"), total)
        if counts.commit() == commit:
            return  # output and counts are there already
        minute = F.date_trunc("minute", F.col("received_at"))
        hour = F.floor(F.unix_timestamp(minute) / 3600).alias("hour")
        own = batch.groupBy(minute.alias("minute"), "ip").agg(F.count("*").alias("seen"))
        own = own.select(F.floor(F.unix_timestamp("minute") / 3600).alias("hour"), F.pmod(F.xxhash64("ip"), F.lit(RATE_PARTS)).cast("int").alias("part"), "minute", "ip", "seen").persist()
        try:
            before = counts.read(own.select("hour", "part").distinct())
            first = ingest.ingest_rate_limit(batch.withColumn("_at", minute), most, place="_n")
            if before is not None:
                first = first.join(before.select(F.col("minute").alias("_at"), "ip", F.col("seen").alias("_seen")), ["_at", "ip"], "left")
                first = first.where(F.col("_n") + F.coalesce("_seen", F.lit(0)) <= most)
            first.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/passed/commit={commit}")
            newest = own.agg(F.max("hour")).first()[0]
            if newest is not None:
                counts.merge(own, commit, keep=F.col("hour") >= newest - memory_hours)
        finally:
            own.unpersist()

    return batches.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_passed(spark: SparkSession, path: str) -> DataFrame:
    """The batches that a rate limit let through."""
    return spark.read.parquet(f"{path}/passed").drop("commit")


#: Session windows also join events that lie just the gap apart; times have microseconds, so a gap that is one shorter splits there.
WINDOW_GAP = f"{SESSION_GAP_SECONDS * 1_000_000 - 1} microseconds"


def stream_session_windows(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Sessions by a 30-minute gap in Spark's session windows: they span the store's midnight and split at the gap itself."""
    sessions = events.withWatermark("occurred_at", delay).groupBy(F.session_window("occurred_at", WINDOW_GAP), "tenant_id", "visitor_key")
    ends_at = F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND")
    return sessions.agg(F.count("*").alias("events")).select("tenant_id", "visitor_key", F.col("session_window.start").alias("started_at"), ends_at.alias("ends_at"), "events")


#: Slots of a store day lie in so many parts.
SLOT_PARTS = 16


def stream_sessions(events: DataFrame, path: str, rollup_path: str, checkpoint: str, tenants: DataFrame, open_days: int | None = None) -> StreamingQuery:
    """Sessions of each store day, as ``rollups.sessions_daily`` counts them, kept current in ``rollup_path``.

    The state is a row per (tenant, store day, visitor, half hour) with its first and last event, which more events only widen: so late
    events, replays and repeated batches need no care. A batch rewrites the parts of the days it touches and counts these days again.
    With ``open_days``, events of days that are further behind their tenant's newest day are left out.
    """
    keys = (*rollups.DAY, "visitor_key", "_slot")

    def widen(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "part").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = PartStore(spark, path, (*rollups.DAY, "part"), widen)
        second = F.col("occurred_at").cast("long")
        slots = rollups.with_day(batch, tenants, "occurred_at").withColumn("stat_date", F.col("stat_date").cast("string"))
        slots = slots.groupBy(*rollups.DAY, "visitor_key", F.floor(second / SESSION_GAP_SECONDS).alias("_slot")).agg(F.min(second).alias("_first"), F.max(second).alias("_last"))
        slots = slots.withColumn("part", F.pmod(F.xxhash64("visitor_key", "_slot"), F.lit(SLOT_PARTS)).cast("int")).persist()
        try:
            days = slots.select(*rollups.DAY).distinct()
            if open_days is not None:
                known = store.manifest()
                seen = days if known is None else days.unionByName(known[1].select("tenant_id", F.col("stat_date").cast("string").alias("stat_date")).distinct())
                newest = seen.groupBy("tenant_id").agg(F.max("stat_date").alias("_newest"))
                days = days.join(newest, "tenant_id").where(F.datediff("_newest", "stat_date") <= open_days).drop("_newest")
            days = days.persist()
            store.merge(slots.join(days, list(rollups.DAY), "left_semi"), f"{_stream_id(spark, checkpoint)}-{number}")
            stored = store.read(days)
            sink_rollup(rollups.sessions_of_slots(stored), rollup_path)
            days.unpersist()
        finally:
            slots.unpersist()

    return events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_live_visitors(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Visitors an hour, approximately; exact figures come from ``stream_kpi``."""
    hourly = events.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", "1 hour"), "tenant_id")
    return hourly.agg(F.approx_count_distinct("visitor_key").alias("visitors"), F.count("*").alias("events")).select(F.col("window.start").alias("hour"), "tenant_id", "visitors", "events")


def _held(files: TableFiles) -> dict:
    """``run``: how often held files were offered again, and ``files``: the path of each by its name."""
    return json.loads(files.folder.read_text("_held.json")) if files.folder.exists("_held.json") else {"run": 0, "files": {}}


def held_files(spark: SparkSession, table: str) -> DataFrame:
    """``_file, _path`` of feed files that wait because a line of theirs has no place yet."""
    return spark.createDataFrame(sorted(_held(TableFiles(spark, table))["files"].items()), "_file string, _path string")


def stream_ingest(
    spark: SparkSession, feed: str, table: str, checkpoint: str, tenants: DataFrame, now: Callable[[], datetime], max_files: int = 200, audit: str | None = None,
    registry: DataFrame | None = None, since: str = "",
) -> StreamingQuery:
    """Drain the landed files of closed hours into the event table, each event once, for good.

    Keys are looked up in an index of all stored ones (``KeyIndex``), whatever day or clock an event has. With ``registry`` (see
    ``ingest.event_route``), a file with an event of a day that has no place is held back as a whole: none of its lines is stored
    or counts as seen, its audit says failed, and each later run offers it again, until the registry has that day. With ``audit``, each
    batch leaves its ``import_audit`` there.

    A batch is staged, then a journal brings its files into the table and its keys into the index. If it is tried again, what it had
    staged is dropped before the journal, and completed after it. ``since`` (``yyyymmddhh``) leaves older hours out of the listing,
    once they have been read.
    """
    index = KeyIndex(spark, f"{table}/_keys")

    def remember(commit: str, paths: list[str]) -> None:
        if paths:
            index.add(spark.read.option("basePath", files.folder.path).parquet(*paths), commit)

    files = TableFiles(spark, table, then=remember)
    files.recover()
    if not index.commits() and files.folder.files(""):  # a table from before there was an index
        index.add(spark.read.parquet(table), "table")

    def store(lines: DataFrame, commit: str, offered: int = 0) -> None:
        if files.finished(commit):
            return
        files.abandon(commit)
        index.merge_commits()
        mapped = ingest.event_map_type(lines).persist()
        kept = [mapped]
        try:
            typed = ingest.event_shred(mapped.where("_corrupt is null"), tenants, now())
            held, waiting = None, _held(files)
            if registry is not None:
                astray = ingest.event_route(typed, registry).where("shard_id is null").select("_file").distinct()
                held = mapped.select("_file", "_path").distinct().join(astray, "_file", "left_semi").persist()  # at most the files of a batch
                kept.append(held)
                typed = typed.join(F.broadcast(held.select("_file")), "_file", "left_anti")
                for r in mapped.select("_file").distinct().collect():
                    waiting["files"].pop(r["_file"], None)
                waiting["files"] |= {r["_file"]: unquote(r["_path"]) for r in held.collect()}
                waiting["run"] += offered
            stored = index.stored(typed.select("tenant_id", "event_uid")).persist()
            kept.append(stored)
            if audit:
                counts = ingest.import_audit(ingest.classify_lines(mapped, stored, held))
                counts.write.mode("overwrite").parquet(f"{audit}/batch={commit}")
            sink_events(ingest.event_dedup(typed, stored), files.staging(commit), "overwrite")
            files.commit(commit, texts={"_held.json": json.dumps(waiting)} if registry is not None else None)
        finally:
            for df in kept:
                df.unpersist()

    waiting = _held(files) if registry is not None else {"files": {}}
    if waiting["files"]:
        store(read_feed_files(spark, sorted(waiting["files"].values())), f"held-{waiting['run']}", 1)
    writer = stream_event_feed(spark, feed, now(), max_files, since).writeStream.foreachBatch(lambda batch, number: store(batch, f"{_stream_id(spark, checkpoint)}-{number}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_kpi(arriving: DataFrame, table: str, rollup_path: str, checkpoint: str, compute: Callable[[DataFrame, DataFrame], DataFrame], day_of: Callable[[DataFrame], DataFrame], is_open: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Recompute the open store days that a batch touches, from the stored events, and overwrite those partitions.

    ``day_of`` adds ``stat_date``; ``is_open`` keeps the (tenant_id, stat_date) rows that are young enough; ``compute``
    takes (events of those days, the days) and returns the rollup. Later data is stored but no longer counted.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = is_open(day_of(batch).select("tenant_id", "stat_date").distinct()).persist()
        try:
            bounds = days.agg(F.date_sub(F.min("stat_date"), 1).alias("lo"), F.date_add(F.max("stat_date"), 1).alias("hi")).first()
            if bounds["lo"] is None:
                return
            stored = spark.read.parquet(table).where(F.col("event_date").between(F.lit(bounds["lo"]), F.lit(bounds["hi"])))
            touched = day_of(stored).join(F.broadcast(days), ["tenant_id", "stat_date"], "left_semi")
            sink_rollup(compute(touched, days), rollup_path)
        finally:
            days.unpersist()

    return arriving.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of a tenant's orders; a batch rewrites only those it has orders of.
ORDER_PARTS = 64


def order_store(spark: SparkSession, path: str) -> PartStore:
    """Orders as mergeable states (see ``orders.order_states``)."""
    return PartStore(spark, path, ("tenant_id", "part"), orders.fold_states)


def read_orders(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The stored orders: of each part the version that the newest manifest names (no rows of ``like`` where none are stored)."""
    states = order_store(spark, path).read()
    if states is None and like is not None:
        return like.limit(0)
    if states is None:
        raise FileNotFoundError(f"no complete version of the orders in {path}")
    return orders.orders_of_states(states.drop("part"))


def merge_into_orders(spark: SparkSession, versions: DataFrame, path: str, commit: str) -> bool:
    """Merge order versions into the stored orders, in any order of arrival; see ``PartStore.merge``."""
    states = orders.order_states(versions).withColumn("part", F.pmod(F.xxhash64("order_id"), F.lit(ORDER_PARTS)).cast("int"))
    return order_store(spark, path).merge(states, commit)


def stream_order_merge(arriving: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep one row per order in ``path``, to be read by ``read_orders``.

    Orders lie in ORDER_PARTS parts a tenant, as states that carry when each kept value was set: whatever order versions
    arrive in, the result is that of all at once. A batch that should follow others but finds no manifest, or not the rows it
    names, fails rather than start anew; a new checkpoint on stored orders goes on from them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and order_store(spark, path).manifest() is None:
            raise RuntimeError(f"batch {number} finds no stored orders in {path}, though batches before it stored some")
        merge_into_orders(spark, batch, path, f"{_stream_id(spark, checkpoint)}-{number}")

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete versions and manifests that the newest manifest does not need; returns how many versions went."""
    return order_store(spark, path).retire(keep=1)
