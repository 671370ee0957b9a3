"""Metrics that only a plan describes: abandonment in a time window, express checkout, order gaps, paths to purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import percent
from tallyloom.schemas import CART, CHECKOUT, COMPLETED, DIRECT


def _abandonment(events: DataFrame, entered: int, done: int, hours: int, label: str) -> DataFrame:
    """Visitors of a day whose first ``entered`` event has no ``done`` event within ``hours`` after it (any day)."""
    starts = events.where(F.col("event_type") == entered).groupBy("tenant_id", "visitor_key", "stat_date").agg(F.min("occurred_at").alias("at"))
    ends = events.where(F.col("event_type") == done).select("tenant_id", "visitor_key", F.col("occurred_at").alias("done_at"))
    in_time = (starts["tenant_id"] == ends["tenant_id"]) & (starts["visitor_key"] == ends["visitor_key"]) & F.col("done_at").between(F.col("at"), F.col("at") + F.expr(f"INTERVAL {hours} HOURS"))
    left = starts.join(ends, in_time, "left_anti").groupBy("tenant_id", "stat_date").agg(F.count("*").alias("abandoned"))
    sums = starts.groupBy("tenant_id", "stat_date").agg(F.count("*").alias(label))
    joined = sums.join(left, ["tenant_id", "stat_date"], "left").na.fill(0, ["abandoned"])
    return joined.withColumn("abandon_pct", percent("abandoned", label))


def cart_abandonment(events: DataFrame, hours: int = 24) -> DataFrame:
    return _abandonment(events, CART, CHECKOUT, hours, "carted")


def checkout_abandonment(events: DataFrame, hours: int = 24) -> DataFrame:
    return _abandonment(events, CHECKOUT, COMPLETED, hours, "started")


def express_checkout(visitors: DataFrame) -> DataFrame:
    """Of the visitors at checkout, those who never had a cart that day."""
    at, carted = F.col(f"n_{CHECKOUT}") > 0, F.col(f"n_{CART}") > 0
    sums = visitors.groupBy("tenant_id", "stat_date").agg(F.count_if(at).alias("checkout_visitors"), F.count_if(at & ~carted).alias("express_visitors"))
    return sums.withColumn("express_pct", percent("express_visitors", "checkout_visitors"))


def days_between_orders(orders: DataFrame) -> DataFrame:
    """Median and mean days between consecutive orders of a person, cancelled ones left out."""
    valid = orders.where("cancelled_at is null and person_id is not null")
    before = F.lag("created_at").over(Window.partitionBy("tenant_id", "person_id").orderBy("created_at", "order_id"))
    gaps = valid.withColumn("gap", (F.col("created_at").cast("long") - before.cast("long")) / 86400).where("gap is not null")
    # gaps repeat, so equal ones are counted before the percentile holds them
    counts = gaps.groupBy("tenant_id", "gap").agg(F.count("*").alias("n"))
    return counts.groupBy("tenant_id").agg(
        F.sum("n").alias("pairs"), F.expr("percentile(gap, 0.5, n)").alias("median_days"), F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 4).alias("mean_days")
    )


def unattributed_split(attribution: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Direct orders by whether a click id could recover them."""
    tags = campaigns.select("tenant_id", "campaign_id", (F.col("has_gclid") | F.col("has_fbclid")).alias("_click"))
    direct = attribution.where(F.coalesce("channel", F.lit(DIRECT)) == DIRECT).join(tags, ["tenant_id", "campaign_id"], "left")
    kind = F.when(F.coalesce("_click", F.lit(False)), "recoverable").otherwise("unknown").alias("kind")
    return direct.groupBy("tenant_id", "model", kind).agg(F.count("*").alias("orders"))


def path_to_purchase(orders: DataFrame) -> DataFrame:
    """How many orders took how many days and moments."""
    return orders.where("cancelled_at is null").groupBy("tenant_id", "days_to_conversion", "moments_count").agg(F.count("*").alias("orders"))


def net_revenue(kpis: DataFrame) -> DataFrame:
    net: Column = F.col("revenue_minor") - F.col("refunded_minor")
    return kpis.select("tenant_id", "stat_date", "revenue_minor", "refunded_minor", net.alias("net_minor"))
