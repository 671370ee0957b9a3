"""Pulling orders page by page: where each tenant stands is stored after every page, so a run that stops is resumed there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.orders import OVERLAP_SECONDS
from tallyloom.sources.files import Versions

#: A tenant's ``watermark`` moves once all pages are in; until then ``token_at, token_id`` name the last order of the last page,
#: ``newest`` the watermark to come, and ``since`` where this pull began.
CURSORS = "tenant_id int, watermark timestamp, since timestamp, token_at timestamp, token_id bigint, newest timestamp, run string"
PAGE, PAGES = 100_000, 40
#: Up to so many tenants are named in the filter of the scan.
NAMED = 1000


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """Where each tenant stands."""
    stored = Versions(spark, path)
    newest = stored.newest()
    return spark.createDataFrame([], CURSORS) if newest is None else stored.read(newest)


def sync_orders(spark: SparkSession, source: DataFrame, path: str, apply: Callable[[DataFrame, str], object], run: str, page: int = PAGE, pages: int = PAGES) -> int:
    """Pull what is new in ``source`` (``tenant_id, order_id, updated_at`` and more), all tenants a page at a time; returns the pages.

    A pull of a tenant covers ``updated_at`` from its watermark less OVERLAP_SECONDS on, in order of (updated_at, order_id). ``apply``
    gets each page and a name for it, and must bear to get it twice (``streams.merge_into_orders`` does); then the cursors are
    written, as a whole. A crash after page k so goes on with page k + 1, or with page k again, and a watermark only moves after a
    tenant's last page. A tenant that is done rests for the rest of this ``run``; after ``pages`` pages the next run goes on. No
    more than ``page`` rows a tenant and task leave the scan.
    """
    stored, done = Versions(spark, path), 0
    while done < pages:
        number = stored.newest()
        state = cursors(spark, path)
        here = state.select(*(F.col(c).alias(c if c == "tenant_id" else f"_{c}") for c in state.columns))
        begin = F.coalesce("_since", F.col("_watermark") - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS"))
        rows = source.where("updated_at is not null and order_id is not null").join(F.broadcast(here), "tenant_id", "left")  # a row a tenant
        resting = F.col("_token_at").isNull() & F.coalesce(F.col("_run") == run, F.lit(False))
        after = F.col("_token_at").isNull() | (F.struct("updated_at", "order_id") > F.struct(F.col("_token_at").alias("updated_at"), F.col("_token_id").alias("order_id")))
        rows = rows.where(~resting & (begin.isNull() | (F.col("updated_at") >= begin)) & after)
        lows = state.select(F.coalesce("since", F.col("watermark") - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS")).alias("low"))
        least = lows.agg(F.count("*"), F.count("low"), F.min("low")).first()
        if 0 < least[0] == least[1] and least[0] <= NAMED:  # what the scan can use; tenants without a row are new and need everything
            known = [r["tenant_id"] for r in state.select("tenant_id").collect()]
            rows = rows.where((F.col("updated_at") >= F.lit(least[2])) | ~F.col("tenant_id").isin(known))
        place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("updated_at", "order_id"))
        now = rows.withColumn("_place", place).where(F.col("_place") <= page).persist()
        try:
            last = F.max(F.struct("updated_at", "order_id"))
            ends = now.groupBy("tenant_id").agg(F.count("*").alias("_rows"), last.alias("_end")).persist()
            if not ends.isEmpty():
                apply(now.select(*source.columns), f"{run}-{number if number is not None else 'first'}")
            joined = state.join(ends, "tenant_id", "full")
            full, seen = F.col("_rows") == page, F.col("_rows").isNotNull()
            # the time of this page's last order, or of what came before
            newest = F.greatest("newest", "watermark", F.col("_end.updated_at"))
            began = F.when(F.col("token_at").isNotNull(), F.col("since")).otherwise(F.col("watermark") - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS"))
            over = ~F.coalesce(full, F.lit(False))
            moved = joined.select(
                "tenant_id", F.when(over, newest).otherwise(F.col("watermark")).alias("watermark"), F.when(~over, began).alias("since"),
                F.when(~over, F.col("_end.updated_at")).alias("token_at"), F.when(~over, F.col("_end.order_id")).alias("token_id"),
                F.when(~over, newest).alias("newest"), F.lit(run).alias("run"),
            )
            more = not ends.where(F.col("_rows") == page).isEmpty()
            any_rows = not ends.isEmpty()
            stored.write(moved, 0 if number is None else number + 1)
            stored.retire()
            ends.unpersist()
        finally:
            now.unpersist()
        done += any_rows
        if not more:
            break
    return done
