"""The benchmark tables as store data: behaviour, two kinds of orders, identity keys and URLs.

The mappings are conventions for tests, not claims about the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.small import small_table
from tallyloom.schemas import DEFAULT_RULES

ZONE = "Asia/Kolkata"
NOW_EVENTS = "2024-01-31 00:00:00"
NOW_ORDERS = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenants(spark: SparkSession) -> DataFrame:
    at = datetime(2024, 1, 5)
    rows = [
        (1, "one.example.com", "www.one.example", "key-one", ZONE, True, "active", at, None, None, None),
        (2, "two.example.com", None, "key-two", "UTC", False, "uninstalled", at, at, at, None),
    ]
    ddl = (
        "tenant_id INT, shop_domain STRING, custom_domain STRING, write_key STRING, iana_timezone STRING, "
        "refunded_counts_as_order BOOLEAN, status STRING, installed_at TIMESTAMP, uninstalled_at TIMESTAMP, purge_after TIMESTAMP, purged_at TIMESTAMP"
    )
    return small_table(spark, rows, ddl)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    code = (
        F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "signup", 6)
        .when(F.col("event_type") == "error", 8).when(F.col("event_type") == "purchase", 13)
    )
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.lit(1).alias("tenant_id"),
        F.col("event_id").alias("event_uid"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("occurred_at"),
        F.col("user_id").alias("visitor_key"),
        code.alias("event_type"),
        F.col("k").alias("path_id"),
        F.when(F.col("k") % 4 != 0, F.col("k")).alias("campaign_id"),
        F.when(F.col("k") % 3 != 0, F.col("k") % 5 + 1).alias("referrer_id"),
        F.when(F.col("event_type").isin("view", "click", "signup"), F.col("k")).alias("product_id"),
        (F.col("k") % 10).alias("geo_id"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 7).alias("ua_id"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("order_ref"),
        F.col("value"),
    )


def dim_campaign(spark: SparkSession) -> DataFrame:
    """Campaigns 1 to 99; those divisible by 4 are never used."""
    c = F.col("id")
    source = (
        F.when(c % 9 == 0, "instagram").when(c % 9 == 1, "facebook_ads").when(c % 9 == 2, "google").when(c % 9 == 3, "newsletter")
        .when(c % 9 == 4, "klaviyo").when(c % 9 == 5, "partner")
    )
    medium = F.when(c % 5 == 0, "cpc").when(c % 5 == 1, "email").when(c % 5 == 2, "social")
    return spark.range(1, 100).select(
        F.lit(1).alias("tenant_id"), c.alias("campaign_id"), source.alias("utm_source"), medium.alias("utm_medium"),
        F.when(c % 2 == 1, F.concat(F.lit("camp-"), c.cast("string"))).alias("utm_campaign"),
        (c % 11 == 0).alias("has_gclid"), (c % 13 == 0).alias("has_fbclid"),
    )


def dim_referrer(spark: SparkSession) -> DataFrame:
    hosts = ["www.google.com", "l.facebook.com", "shop.partner.example", "www.bing.com", "www.pinterest.com"]
    return small_table(spark, [(1, i + 1, h) for i, h in enumerate(hosts)], "tenant_id INT, referrer_id BIGINT, referrer_host STRING")


def dim_path(spark: SparkSession) -> DataFrame:
    path = F.concat(F.when(F.col("id") % 2 == 0, F.lit("/products/")).otherwise(F.lit("/pages/")), F.col("id").cast("string"))
    return spark.range(0, 100).select(F.lit(1).alias("tenant_id"), F.col("id").alias("path_id"), path.alias("path"))


def dim_useragent(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 1, "Safari", "iOS"), (1, 2, 1, "Chrome", "Android"), (1, 3, 2, "Chrome", "Windows"), (1, 4, 2, "Chrome", "Windows"), (1, 5, 3, "Safari", "iOS"), (1, 6, 4, None, None)]
    return small_table(spark, rows, "tenant_id INT, ua_id BIGINT, device_type INT, browser STRING, os STRING")


def dim_geo(spark: SparkSession) -> DataFrame:
    g = F.col("id")
    return spark.range(0, 9).select(
        g.alias("geo_id"), F.when(g % 2 == 0, "in").otherwise("us").alias("country"),
        F.when(g % 3 != 0, F.concat(F.lit("region"), g.cast("string"))).alias("region"),
        F.when(g % 4 != 0, F.concat(F.lit("city"), g.cast("string"))).alias("city"),
    )


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase event is an order."""
    got = events(spark, sf_dir).where("event_type = 13")
    total = F.round(F.col("value") * 100).cast("bigint")
    return got.select(
        "tenant_id", F.col("event_uid").alias("order_id"), F.col("visitor_key").alias("person_id"), "visitor_key",
        F.col("occurred_at").alias("created_at"), F.when(F.col("event_uid") % 17 == 0, F.col("occurred_at")).alias("cancelled_at"),
        total.alias("total_minor"), F.when(F.col("event_uid") % 10 == 0, total).otherwise(F.lit(0)).cast("bigint").alias("refunded_minor"),
        F.when(F.col("event_uid") % 10 == 0, "REFUNDED").otherwise("PAID").alias("financial_status"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = event_orders(spark, sf_dir)
    return orders.select("tenant_id", "order_id", (F.col("order_id") % 50).alias("product_id"), (F.col("order_id") % 3 + 1).cast("int").alias("quantity"))


def star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancelled = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("5")
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.lit(1).alias("tenant_id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("person_id"),
        at.alias("created_at"), F.when(cancelled, at).alias("cancelled_at"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_minor"), F.lit(0).cast("bigint").alias("refunded_minor"),
        F.when(F.col("o_orderkey") % 11 == 0, "REFUNDED").otherwise("PAID").alias("financial_status"), "o_orderstatus",
    )


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("tenant_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("price_minor"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("bigint").alias("discount_minor"),
    )


def identity_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order per customer, with keys by arithmetic: components of several sizes and some orders without a key."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit(1).alias("tenant_id"), c.alias("order_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast((c_custkey * 7919) % 5000 AS INT))").alias("created_at"),
        F.when(c % 5 != 0, F.concat(F.lit("c"), ((c / 2).cast("bigint")).cast("string"))).alias("customer_hash"),
        F.when(c % 7 == 0, F.concat(F.lit("p"), ((c / 14).cast("bigint")).cast("string"))).alias("phone_hash"),
        F.when(c % 11 == 0, F.concat(F.lit("e"), ((c / 33).cast("bigint")).cast("string"))).alias("email_hash"),
        (c % 40).alias("visitor_key"),
    )


def rules(spark: SparkSession, tenant_ids: tuple[int, ...] = (1,)) -> DataFrame:
    rows = [(t, *r, True) for t in tenant_ids for r in DEFAULT_RULES]
    return small_table(spark, rows, "tenant_id INT, priority INT, match_field STRING, match_op STRING, match_value STRING, channel STRING, enabled BOOLEAN")
