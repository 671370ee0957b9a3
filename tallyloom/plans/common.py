"""Inputs that several registered queries share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.small import small_table
from tallyloom.operators import attribution as at
from tallyloom.operators import identity, rollups
from tallyloom.plans.lineage import cut_lineage
from tallyloom.sources import adapters as ad

START, END = date(2024, 1, 11), date(2024, 1, 25)
C_START, C_END = date(1998, 3, 1), date(1998, 6, 30)
C_TODAY = date(2001, 9, 1)


def store(spark: SparkSession) -> DataFrame:
    return ad.tenants(spark).where("tenant_id = 1")


def ev(spark: SparkSession, d: str) -> DataFrame:
    return rollups.with_day(ad.events(spark, d), store(spark), "occurred_at")


def ob(spark: SparkSession, d: str) -> DataFrame:
    return rollups.with_day(identity.order_sequence(ad.event_orders(spark, d), store(spark)), store(spark), "created_at")


def oc(spark: SparkSession, d: str) -> DataFrame:
    return rollups.with_day(identity.order_sequence(ad.star_orders(spark, d), store(spark)), store(spark), "created_at")


def spine(spark: SparkSession, d: str) -> DataFrame:
    nothing = small_table(spark, [], "tenant_id INT, stat_date DATE, is_provisional INT")
    return rollups.day_spine(store(spark), ad.event_orders(spark, d), nothing, ad.NOW_EVENTS, limit=100)


def vd(spark: SparkSession, d: str) -> DataFrame:
    return rollups.visitor_days(ev(spark, d))


def kpi(spark: SparkSession, d: str) -> DataFrame:
    return rollups.kpi_daily(spine(spark, d), vd(spark, d), ob(spark, d), ad.event_lines(spark, d), store(spark), ad.NOW_EVENTS)


def open_checkouts(orders: DataFrame, condition: str) -> DataFrame:
    kept = orders.where(condition).withColumn("completed_at", F.lit(None).cast("timestamp"))
    return kept.select("tenant_id", F.col("order_id").alias("checkout_id"), "stat_date", "created_at", "completed_at", "total_minor")


def visitors(spark: SparkSession, d: str) -> DataFrame:
    return ad.events(spark, d).select("tenant_id", "visitor_key", F.col("visitor_key").alias("person_id")).distinct()


def pixel(spark: SparkSession, d: str) -> DataFrame:
    orders = ad.event_orders(spark, d)
    wanted = at.attr_visitor_set(orders, visitors(spark, d))
    return at.attr_pixel_first_last(orders, wanted, at.attr_touches(ad.events(spark, d), wanted))


def platform(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("order_id")
    models = small_table(spark, [("shopify_first",), ("shopify_last",)], "model STRING")
    orders = ad.event_orders(spark, d).where(key % 3 != 0).join(F.broadcast(models))
    return orders.select(
        "tenant_id", "order_id", "model", F.when((key % 97 + 1) % 4 != 0, key % 97 + 1).alias("campaign_id"), F.when(key % 2 == 0, key % 5 + 1).alias("referrer_id"),
        (key % 100).alias("landing_path_id"), F.col("created_at").alias("touch_at"),
    )


def dims(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ad.dim_campaign(spark), ad.dim_referrer(spark), ad.dim_path(spark)


def unclassified(spark: SparkSession, d: str) -> DataFrame:
    return pixel(spark, d).unionByName(platform(spark, d)).withColumn("channel", F.lit(None).cast("string"))


def attr(spark: SparkSession, d: str) -> DataFrame:
    return at.channel_backfill(unclassified(spark, d), ad.rules(spark), *dims(spark))


def classifier(spark: SparkSession):
    def classify(pairs: DataFrame) -> DataFrame:
        triples = pairs.withColumn("path_id", F.lit(None).cast("bigint"))
        return at.channel_classify(triples, ad.rules(spark), *dims(spark)).drop("path_id")

    return classify


def campaign_rows(spark: SparkSession, d: str) -> DataFrame:
    return rollups.campaign_daily(ev(spark, d), ob(spark, d), attr(spark, d))


def channel_rows(spark: SparkSession, d: str) -> DataFrame:
    return rollups.channel_daily(ev(spark, d), ob(spark, d), attr(spark, d), classifier(spark))


def product_rows(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = oc(spark, d), ad.star_lines(spark, d)
    left = open_checkouts(orders, "o_orderstatus = 'P'")
    items = lines.select("tenant_id", F.col("order_id").alias("checkout_id"), "product_id")
    return rollups.product_daily(ev(spark, d), orders, lines, left, items)


def first_touch(orders: DataFrame) -> DataFrame:
    """Synthetic acquiring campaigns for star-schema orders."""
    c = F.col("order_id") % 40
    return orders.select("tenant_id", "order_id", F.lit("pixel_first").alias("model"), F.when(c % 4 != 0, c).alias("campaign_id"))


DAILY = ("kpi", "funnel", "campaign", "channel", "landing", "product", "geo", "device", "abandon")


def daily_rollups(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All nine daily rollups from shared inputs: dated events, visitor days, numbered orders and attribution are each made once."""
    events, orders = cut_lineage(ev(spark, d)), cut_lineage(ob(spark, d))
    visitors, attributed = cut_lineage(rollups.visitor_days(events)), cut_lineage(attr(spark, d))
    days, stores, lines = spine(spark, d), store(spark), ad.event_lines(spark, d)
    left = open_checkouts(orders, "order_id % 5 = 0")
    priced = lines.withColumns({"price_minor": F.lit(100), "discount_minor": F.lit(10)})
    items = lines.select("tenant_id", F.col("order_id").alias("checkout_id"), "product_id")
    return {
        "kpi": rollups.kpi_daily(days, visitors, orders, lines, stores, ad.NOW_EVENTS), "funnel": rollups.funnel_daily(days, visitors),
        "campaign": rollups.campaign_daily(events, orders, attributed), "channel": rollups.channel_daily(events, orders, attributed, classifier(spark)),
        "landing": rollups.landing_daily(events, orders, attributed), "product": rollups.product_daily(events, orders, priced, left, items),
        "geo": rollups.geo_daily(events, orders), "device": rollups.device_daily(events, orders, ad.dim_useragent(spark)), "abandon": rollups.abandon_daily(days, visitors, left),
    }
