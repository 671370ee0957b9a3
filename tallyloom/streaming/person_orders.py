"""What a change of persons makes stale, and only that: orders renumbered by person, then the days they lie on.

Orders are stored twice, in parts by person and in parts by month of their store day. An identity run (``identity.identity_incremental``) touches some
persons: their orders alone are read and numbered again, the rows that differ are merged into both stores, and their days go
into a queue, which ``refresh_days`` drains. So a run reads and writes in proportion to the persons it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import identity, rollups
from tallyloom.sources.files import PartStore, Versions
from tallyloom.sources.sinks import sink_rollup

#: Parts of a tenant's orders by person.
PERSON_PARTS = 64
KEYS = ["tenant_id", "order_id"]


def person_part(person: str | Column = "person_id") -> Column:
    return F.pmod(F.xxhash64(F.col(person) if isinstance(person, str) else person), F.lit(PERSON_PARTS)).cast("int")


def _month(day: str = "stat_date") -> Column:
    return (F.year(day) * 100 + F.month(day)).alias("month")


def _newest(rows: DataFrame) -> DataFrame:
    """Of each order in a part the row of the latest run; one that has left the part goes."""
    place = [c for c in ("tenant_id", "part", "month") if c in rows.columns]
    own = [c for c in rows.columns if c not in (*place, "order_id")]
    one = rows.groupBy(*place, "order_id").agg(F.max_by(F.struct(*own), F.struct("_run", ~F.col("_gone"))).alias("_row"))
    return one.select(*place, "order_id", "_row.*").where("not _gone").select(*rows.columns)


def _stores(spark: SparkSession, path: str) -> tuple[PartStore, PartStore]:
    return PartStore(spark, f"{path}/persons", ("tenant_id", "part"), _newest), PartStore(spark, f"{path}/days", ("tenant_id", "month"), _newest)


def stored_orders(spark: SparkSession, path: str, days: DataFrame | None = None) -> DataFrame | None:
    """The orders with their persons and numbers; with ``days`` (``tenant_id, stat_date``), of those days only."""
    by_person, by_day = _stores(spark, path)
    found = by_person.read() if days is None else by_day.read(days.select("tenant_id", _month()).distinct())
    if found is not None and days is not None:
        found = found.join(days.select("tenant_id", "stat_date"), ["tenant_id", "stat_date"], "left_semi")
    return None if found is None else found.drop("part", "month", "_run", "_gone")


def apply_identity(spark: SparkSession, path: str, incremental: DataFrame, new_orders: DataFrame, tenants: DataFrame, run: int) -> None:
    """Bring an identity run into the stored orders. ``new_orders`` has no persons yet; ``run`` numbers runs upwards.

    A run that is repeated after a crash goes on where it stopped: days are queued first, then stored by day, then by person.
    """
    by_person, by_day = _stores(spark, path)
    if by_person.commit() == f"run{run}":
        return
    moves = incremental.where("node_kind = 'person'").select("tenant_id", F.col("node_id").alias("person_id"), F.col("person_id").alias("_to"))
    named = incremental.where("node_kind = 'order'").select("tenant_id", F.col("node_id").alias("order_id"), "person_id")
    touched = moves.select("tenant_id", "person_id").unionByName(moves.select("tenant_id", F.col("_to").alias("person_id"))).unionByName(named.select("tenant_id", "person_id")).distinct().persist()
    fresh = rollups.with_day(new_orders.drop("person_id", "order_sequence", "stat_date"), tenants, "created_at").withColumn("stat_date", F.col("stat_date").cast("string")).join(named, KEYS)
    before = by_person.read(touched.select("tenant_id", person_part().alias("part")).distinct())
    try:
        every = fresh
        was = None
        if before is not None:
            old = before.join(touched, ["tenant_id", "person_id"], "left_semi").persist()
            was = old.select(*KEYS, F.col("person_id").alias("_person"), F.col("order_sequence").alias("_number"))
            moved = old.drop("part", "_run", "_gone", "order_sequence").join(moves, ["tenant_id", "person_id"], "left").withColumn("person_id", F.coalesce("_to", "person_id")).drop("_to")
            again = moved.join(fresh.select(*KEYS), KEYS, "left_anti")  # an order that comes again counts once
            every = again.unionByName(fresh.select(*again.columns))
        numbered = identity.order_sequence(every, tenants)
        if was is None:
            changed = numbered.withColumns({"_person": F.lit(None).cast("bigint"), "_known": F.lit(False)})
        else:
            changed = numbered.join(was.withColumn("_known", F.lit(True)), KEYS, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
            news = fresh.select(*KEYS, F.lit(True).alias("_fresh"))
            changed = changed.join(news, KEYS, "left").where(F.col("_fresh") | ~(F.col("_person").eqNullSafe(F.col("person_id")) & F.col("_number").eqNullSafe(F.col("order_sequence")))).drop("_fresh", "_number")
        changed = changed.persist()
        queue = Versions(spark, f"{path}/dirty")
        queue.write(changed.select("tenant_id", "stat_date").distinct(), run)
        rows = changed.drop("_person", "_known").withColumns({"_run": F.lit(run), "_gone": F.lit(False)})
        by_day.merge(rows.withColumn("month", _month()), f"run{run}")
        placed = rows.withColumn("part", person_part())
        left = changed.where(F.col("_known") & (person_part("_person") != person_part())).withColumns({"part": person_part("_person"), "_run": F.lit(run), "_gone": F.lit(True)})
        by_person.merge(placed.unionByName(left.select(*placed.columns)), f"run{run}")
        changed.unpersist()
    finally:
        touched.unpersist()


def refresh_days(spark: SparkSession, path: str, rollup_path: str, compute: Callable[[DataFrame], DataFrame], is_open: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Compute the queued days anew (those that ``is_open`` keeps), replace them in ``rollup_path`` and empty the queue; returns how many.

    ``compute`` gets the orders of these days.
    """
    queue = Versions(spark, f"{path}/dirty")
    waiting = queue.complete()
    if not waiting:
        return 0
    days = spark.read.parquet(*(f"{queue.folder.path}/at={n}" for n in waiting)).distinct()
    days = (is_open(days) if is_open else days).persist()
    try:
        count = days.count()
        if count:
            sink_rollup(compute(stored_orders(spark, path, days)), rollup_path)
    finally:
        days.unpersist()
    for n in waiting:
        queue.folder.delete(f"at={n}")
    return count
