"""The order feed: flatten, hash, merge, quarantine, link."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import fitted, gid_tail, hmac_hex, minor
from tallyloom.operators.dims import UTM, path_key, referrer_key, with_campaign

OVERLAP_SECONDS = 300
FIRST_VALUE = ("created_at", "currency", "landing_site", "referring_site", "source_name")
KEEP_HASH = ("email_hash", "phone_hash")


def _money(name: str) -> Column:
    return minor(F.col(f"{name}.shopMoney.amount"))


def _instant(text: str) -> Column:
    return F.date_trunc("second", F.col(text).try_cast("timestamp"))


def orders_flatten(raw: DataFrame) -> DataFrame:
    """Nested documents to order rows; ids are the tail of global ids, money is minor units, times are UTC."""
    summary = "customerJourneySummary"
    return raw.select(
        "tenant_id", gid_tail(F.col("id")).alias("order_id"), gid_tail(F.col("customer.id")).alias("shopify_customer_id"), "email", "phone",
        _instant("createdAt").alias("created_at"), _instant("updatedAt").alias("updated_at"), _instant("cancelledAt").alias("cancelled_at"),
        F.col("displayFinancialStatus").alias("financial_status"), F.col("currencyCode").alias("currency"), fitted(F.col("sourceName"), 64).alias("source_name"),
        F.left("landingSite", F.lit(512)).alias("landing_site"), F.left("referringSite", F.lit(512)).alias("referring_site"),
        F.left(F.array_join("discountCodes", ","), F.lit(255)).alias("discount_codes"),
        _money("subtotalPriceSet").alias("subtotal_minor"), _money("totalPriceSet").alias("total_minor"),
        _money("totalDiscountsSet").alias("discount_minor"), _money("totalRefundedSet").alias("refunded_minor"),
        F.coalesce(f"{summary}.ready", F.lit(False)).alias("journey_ready"), F.col(f"{summary}.daysToConversion").alias("days_to_conversion"),
        F.col(f"{summary}.momentsCount.count").alias("moments_count"), F.col("lineItems.nodes").alias("line_nodes"),
        F.struct(F.col(f"{summary}.firstVisit").alias("first"), F.col(f"{summary}.lastVisit").alias("last")).alias("visits"),
    )


def order_states(versions: DataFrame) -> DataFrame:
    """Order versions as states that can be merged: with when, and by which version, each kept value was set.

    Of versions of one time the one with the larger digest of its values counts as the later; a version without a time as the earliest.
    """
    values = [c for c in versions.columns if c not in ("tenant_id", "order_id")]
    stamp = F.struct(F.col("updated_at").alias("at"), F.xxhash64(*(F.to_json(F.struct(c)) for c in values)).alias("tie"))
    hashes = {f"_set_{c}": F.when(F.col(c).isNotNull(), stamp) for c in KEEP_HASH if c in values}
    return versions.withColumns({"_first": stamp, "_last": stamp, **hashes})


def fold_states(states: DataFrame) -> DataFrame:
    """One state an order. Any grouping and order of folds comes to the same."""
    columns = []
    for c in states.columns:
        if c in ("tenant_id", "order_id", "part", "_first") or c.startswith("_set_"):
            continue
        if c == "_last":
            columns += [F.min("_first").alias("_first"), F.max("_last").alias("_last")]
        elif c in FIRST_VALUE:
            columns.append(F.min_by(c, "_first").alias(c))
        elif c in KEEP_HASH:
            columns += [F.max_by(c, f"_set_{c}").alias(c), F.max(f"_set_{c}").alias(f"_set_{c}")]
        else:
            columns.append(F.max_by(c, "_last").alias(c))
    keys = [k for k in ("tenant_id", "part", "order_id") if k in states.columns]
    return states.groupBy(*keys).agg(*columns).select(*states.columns)


def orders_of_states(states: DataFrame) -> DataFrame:
    return states.drop(*(c for c in states.columns if c in ("_first", "_last") or c.startswith("_set_")))


def orders_merge(versions: DataFrame) -> DataFrame:
    """The newest version of each order; some columns keep their first value, hashes survive a null.

    To merge step by step, keep the states of ``order_states`` and fold them.
    """
    return orders_of_states(fold_states(order_states(versions)))


def orders_incremental(orders: DataFrame, watermark: datetime | str | None) -> tuple[DataFrame, DataFrame]:
    """Rows since the watermark less five minutes, and the new watermark (one row)."""
    fresh = orders if watermark is None else orders.where(F.col("updated_at") >= F.lit(watermark).cast("timestamp") - F.expr(f"INTERVAL {OVERLAP_SECONDS} SECONDS"))
    return fresh, fresh.agg(F.max("updated_at").alias("watermark"))


def orders_quarantine(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders that can be stored, rejects with ``reason``)."""
    reason = (
        F.when(F.col("order_id").isNull(), "no id").when(F.col("created_at").isNull(), "bad created_at")
        .when(F.col("updated_at").isNull(), "bad updated_at").when(F.col("total_minor") < 0, "negative total")
    )
    marked = orders.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def quarantine_report(rejects: DataFrame, first: int = 5) -> DataFrame:
    """Per tenant the number of rejects and the first few of them."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("updated_at", "order_id"))
    few = rejects.withColumn("_n", place).withColumn("_few", F.when(F.col("_n") <= first, F.struct("_n", "order_id", "reason")))
    return few.groupBy("tenant_id").agg(F.count("*").alias("rejected"), F.sort_array(F.collect_list("_few")).alias("examples"))


def line_items_explode(flat: DataFrame) -> DataFrame:
    """One row per line item, the newest version of each line id."""
    rows = flat.select("tenant_id", "order_id", "updated_at", F.explode("line_nodes").alias("i")).select(
        "tenant_id", "order_id", gid_tail(F.col("i.id")).alias("line_id"), gid_tail(F.col("i.product.id")).alias("product_id"), gid_tail(F.col("i.variant.id")).alias("variant_id"),
        F.left("i.title", F.lit(255)).alias("title"), F.col("i.sku").alias("sku"), F.coalesce("i.quantity", F.lit(1)).alias("quantity"),
        minor(F.col("i.originalUnitPriceSet.shopMoney.amount")).alias("price_minor"), minor(F.col("i.totalDiscountSet.shopMoney.amount")).alias("discount_minor"), "updated_at",
    )
    newest = F.row_number().over(Window.partitionBy("tenant_id", "line_id").orderBy(F.desc("updated_at")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "updated_at")


def platform_attribution(flat: DataFrame) -> DataFrame:
    """The platform's own first and last visit as attribution rows; their channel is filled in later."""
    visit = lambda m, v: F.struct(F.lit(m).alias("model"), F.col(f"visits.{v}").alias("visit"))
    rows = flat.select("tenant_id", "order_id", F.inline(F.array(visit("shopify_first", "first"), visit("shopify_last", "last")))).where("visit is not null")
    tags = F.col("visit.utmParameters")
    given = [F.when(F.length(tags[k]) > 0, F.concat(F.lit(f"utm_{k}="), F.url_encode(tags[k]))) for k in UTM]
    shown = with_campaign(rows.withColumn("_u", F.concat(F.lit("https://x/?"), F.concat_ws("&", *given))), "_u")
    return shown.select(
        "tenant_id", "order_id", "model", "campaign_id", F.lit(None).cast("string").alias("channel"), path_key(F.col("visit.landingPage")).alias("landing_path_id"),
        referrer_key(F.col("visit.referrerUrl")).alias("referrer_id"), F.date_trunc("second", F.col("visit.occurredAt").try_cast("timestamp")).alias("touch_at"),
    )


def normal_phone(phone: Column) -> Column:
    """Exactly ten digits after a leading 91, then leading zeros, are taken off a longer number; anything else is null."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    local = F.when((F.length(digits) > 10) & digits.startswith("91"), F.substring(digits, 3, 64)).otherwise(digits)
    bare = F.when((F.length(local) > 10) & local.startswith("0"), F.regexp_replace(local, "^0+", "")).otherwise(local)
    return F.when(F.length(bare) == 10, bare)


def normal_email(email: Column) -> Column:
    low = F.lower(F.trim(email))
    return F.when(low.contains("@"), low)


def orders_hash_contacts(flat: DataFrame, pads: DataFrame) -> DataFrame:
    """Replace email, phone and customer id by salted hashes. ``pads``: ``tenant_id, inner_pad, outer_pad`` (one row a tenant)."""
    keyed = flat.join(pads, "tenant_id")
    hashed = lambda value: F.when(value.isNotNull(), hmac_hex(value, F.col("inner_pad"), F.col("outer_pad")))
    return keyed.withColumns({
        "email_hash": hashed(normal_email(F.col("email"))), "phone_hash": hashed(normal_phone(F.col("phone"))),
        "customer_hash": hashed(F.col("shopify_customer_id").cast("string")),
    }).drop("email", "phone", "inner_pad", "outer_pad")


def order_visitor_link(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Orders without a visitor get that of the first event that names them."""
    first = events.where("order_ref is not null").groupBy("tenant_id", F.col("order_ref").alias("order_id")).agg(
        F.min_by("visitor_key", F.struct("occurred_at", "event_uid")).alias("_v")
    )
    return orders.join(first, ["tenant_id", "order_id"], "left").withColumn("visitor_key", F.coalesce("visitor_key", "_v")).drop("_v")
