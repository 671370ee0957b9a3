"""Daily and snapshot rollups. All tenants and all days come out of one job.

Events are first folded to one row per (tenant, store day, visitor, half hour), then per (tenant, store day, visitor): flags,
counts and first times. Distinct counts of any condition are then plain sums of flags, and no row is expanded for several
distinct aggregates. Sessions need no order of single events: gaps of more than half an hour only lie between half hours, so
a visitor-day is at most some fifty rows when it is put in order, however many events it has (all anonymous ones share one).
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import is_provisional, local_day
from tallyloom.functions.small import small_table
from tallyloom.schemas import (
    CART, CHECKOUT, CHECKOUT_STAGES, COHORT_DAYS, DIRECT, FUNNEL_STEPS, MODELS, PAGE, PAYMENT, PRODUCT, RECLOSE_DAYS, SESSION_GAP_SECONDS,
)

DAY = ("tenant_id", "stat_date")


def zones(tenants: DataFrame) -> DataFrame:
    """``tenant_id, iana_timezone``; a name that is no zone counts as UTC."""
    known = F.expr("iana_timezone in (" + ", ".join(f"'{z}'" for z in sorted(available_timezones())) + ")")
    return tenants.select("tenant_id", F.when(known, F.col("iana_timezone")).otherwise("UTC").alias("iana_timezone"))


def with_day(df: DataFrame, tenants: DataFrame, at: str) -> DataFrame:
    """Add ``stat_date``, the store's local day of ``at``; rows of unknown tenants go."""
    named = zones(tenants).withColumnRenamed("iana_timezone", "_zone")
    return df.join(named, "tenant_id").withColumn("stat_date", local_day(at, "_zone")).drop("_zone")


def with_provisional(df: DataFrame, tenants: DataFrame, now: datetime | str) -> DataFrame:
    named = zones(tenants).withColumnRenamed("iana_timezone", "_zone")
    return df.join(named, "tenant_id").withColumn(
        "is_provisional", is_provisional(F.col("stat_date"), F.lit(now).cast("timestamp"), F.col("_zone"), RECLOSE_DAYS)
    ).drop("_zone")


def day_spine(tenants: DataFrame, orders: DataFrame, closed: DataFrame, now: datetime | str, limit: int = 10) -> DataFrame:
    """Days to compute: after the last closed one, else from the first with data (install or first order); oldest first.

    ``closed``: ``tenant_id, stat_date, is_provisional`` of what is stored.
    """
    first = orders.groupBy("tenant_id").agg(F.min("created_at").alias("first_order"))
    last = closed.where("is_provisional = 0").groupBy("tenant_id").agg(F.max("stat_date").alias("last_closed"))
    now_at = F.lit(now).cast("timestamp")
    one = tenants.select("tenant_id", "installed_at").join(zones(tenants), "tenant_id")
    one = one.join(first, "tenant_id", "left").join(last, "tenant_id", "left")
    begin = F.coalesce(
        F.date_add("last_closed", 1), local_day(F.coalesce(F.least("installed_at", "first_order"), now_at), "iana_timezone")
    )
    end = local_day(now_at, "iana_timezone")
    days = F.when(begin <= end, F.slice(F.sequence(begin, end), 1, limit))
    return one.select("tenant_id", F.explode(days).alias("stat_date"))


def days_from(tenants: DataFrame, start: str, now: datetime | str, cap: int = 1200) -> DataFrame:
    end = local_day(F.lit(now).cast("timestamp"), "iana_timezone")
    begin = F.lit(start).cast("date")
    return zones(tenants).select("tenant_id", F.explode(F.when(begin <= end, F.slice(F.sequence(begin, end), 1, cap))).alias("stat_date"))


def session_slots(events: DataFrame, *by: str, aggregates: tuple[Column, ...] = ()) -> DataFrame:
    """One row per group of ``by`` and slot of SESSION_GAP_SECONDS, with ``starts_session`` and ``aggregates`` of its events.

    Two events of a slot are never further apart than the gap, so a session starts at the first event of a slot or not in
    it: where no earlier slot has events, or the last of them is more than the gap before.
    """
    second = F.col("occurred_at").cast("long")
    slots = events.groupBy(*by, F.floor(second / SESSION_GAP_SECONDS).alias("_slot")).agg(F.min(second).alias("_first"), F.max(second).alias("_last"), *aggregates)
    return with_session_starts(slots, *by)


def with_session_starts(slots: DataFrame, *by: str) -> DataFrame:
    """Add ``starts_session`` to slots (``_slot`` with ``_first`` and ``_last``, in seconds)."""
    before = F.lag("_last").over(Window.partitionBy(*by).orderBy("_slot"))
    return slots.withColumn("starts_session", (before.isNull() | (F.col("_first") - before > SESSION_GAP_SECONDS)).cast("long"))


def visitor_days(events: DataFrame) -> DataFrame:
    """One row per (tenant, day, visitor): sessions, page views, ``n_<code>`` counts and ``t_<code>`` first times.

    Both groupings are combined before their shuffle, so the events of a busy visitor never meet in one task.
    """
    codes = sorted({PAGE, PAYMENT, *FUNNEL_STEPS.values(), *CHECKOUT_STAGES.values()})
    is_code = {c: F.col("event_type") == c for c in codes}
    slots = session_slots(
        events, *DAY, "visitor_key",
        aggregates=(*(F.count_if(is_code[c]).alias(f"n_{c}") for c in codes), *(F.min(F.when(is_code[c], F.col("occurred_at"))).alias(f"t_{c}") for c in codes)),
    )
    return slots.groupBy(*DAY, "visitor_key").agg(
        F.sum("starts_session").alias("sessions"), *(F.sum(f"n_{c}").alias(f"n_{c}") for c in codes), *(F.min(f"t_{c}").alias(f"t_{c}") for c in codes)
    )


def _flag(code: int) -> Column:
    return F.count_if(F.col(f"n_{code}") > 0)


def sessions_daily(events: DataFrame) -> DataFrame:
    marked = session_slots(events, *DAY, "visitor_key")
    return marked.groupBy(*DAY).agg(F.sum("starts_session").alias("sessions"))


def sessions_of_slots(slots: DataFrame) -> DataFrame:
    """``sessions_daily`` from stored slots of (tenant, day, visitor, half hour)."""
    return with_session_starts(slots, *DAY, "visitor_key").groupBy(*DAY).agg(F.sum("starts_session").alias("sessions"))


def sessions_by_campaign(events: DataFrame) -> DataFrame:
    tagged = events.withColumn("campaign_id", F.coalesce("campaign_id", F.lit(0).cast("bigint")))
    marked = session_slots(tagged, *DAY, "campaign_id", "visitor_key")
    return marked.groupBy(*DAY, "campaign_id").agg(F.sum("starts_session").alias("sessions"))


def day_orders(orders: DataFrame) -> DataFrame:
    """Orders, buyers and money of each day; new and returning partition the sequenced buyers.

    One pass per person first, so that no distinct count is needed.
    """
    valid = orders.where("cancelled_at is null")
    buyers = valid.groupBy(*DAY, "person_id").agg(
        F.count("*").alias("orders"), F.sum("total_minor").alias("revenue"), F.sum("refunded_minor").alias("refunds"),
        F.max(F.col("order_sequence").isNotNull()).alias("sequenced"), F.max(F.coalesce(F.col("order_sequence") == 1, F.lit(False))).alias("first"),
    )
    known = F.col("person_id").isNotNull()
    return buyers.groupBy(*DAY).agg(
        F.sum("orders").alias("orders"), F.count_if(known).alias("purchasers"),
        F.sum("revenue").alias("revenue_minor"), F.sum("refunds").alias("refunded_minor"),
        F.count_if(known & F.col("first")).alias("new_customers"), F.count_if(known & F.col("sequenced")).alias("_buyers"),
    ).withColumn("repeat_customers", F.greatest(F.lit(0), F.col("_buyers") - F.col("new_customers"))).drop("_buyers")


def kpi_daily(spine: DataFrame, visitors: DataFrame, orders: DataFrame, lines: DataFrame, tenants: DataFrame, now: datetime | str) -> DataFrame:
    """One row per spine day, empty or not. ``visitors`` comes from ``visitor_days``; ``orders`` has ``stat_date``."""
    traffic = visitors.groupBy(*DAY).agg(
        F.count("*").alias("visitors"), F.sum("sessions").alias("sessions"), F.sum(f"n_{PAGE}").alias("pageviews"),
        _flag(PRODUCT).alias("product_viewers"), _flag(CART).alias("atc_visitors"),
        _flag(CHECKOUT).alias("checkout_visitors"), _flag(PAYMENT).alias("payment_visitors"),
    )
    sold = orders.where("cancelled_at is null").select("tenant_id", "order_id", "stat_date")
    units = lines.join(sold, ["tenant_id", "order_id"]).groupBy(*DAY).agg(F.sum("quantity").alias("units"))
    joined = spine.join(traffic, [*DAY], "left").join(day_orders(orders), [*DAY], "left").join(units, [*DAY], "left")
    return with_provisional(joined.na.fill(0), tenants, now)


def funnel_daily(spine: DataFrame, visitors: DataFrame) -> DataFrame:
    """Six rows a day: visitors that reached each step, those that did all steps in order, and raw events."""
    steps = list(FUNNEL_STEPS.items())
    strict: list[Column] = []
    for k, (_, code) in enumerate(steps):
        here = F.col(f"t_{code}")
        ok = here.isNotNull() if k == 0 else strict[-1] & F.coalesce(here >= F.col(f"t_{steps[k - 1][1]}"), F.lit(False))
        strict.append(ok)
    totals = visitors.groupBy(*DAY).agg(
        *(x for (step, code), ok in zip(steps, strict, strict=True) for x in (
            _flag(code).alias(f"reached_{step}"), F.count_if(ok).alias(f"strict_{step}"), F.sum(f"n_{code}").alias(f"events_{step}"),
        ))
    )
    rows = F.array(*(
        F.struct(F.lit(s).alias("step"), *(F.coalesce(F.col(f"{m}_{s}"), F.lit(0)).alias(n) for m, n in (("reached", "reached_visitors"), ("strict", "strict_visitors"), ("events", "events"))))
        for s, _ in steps
    ))
    return spine.join(totals, [*DAY], "left").select(*DAY, F.inline(rows))


def abandon_daily(spine: DataFrame, visitors: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Stages 2 to 7: entered, of those who reached any later stage, the difference; open checkouts stand on stage 3."""
    stages = list(CHECKOUT_STAGES.items())
    flags = {s: F.col(f"n_{c}") > 0 for s, c in stages}
    sums = []
    for k, (s, _) in enumerate(stages):
        later = [flags[x] for x, _ in stages[k + 1 :]]
        moved = flags[s] & reduce(lambda a, b: a | b, later) if later else flags[s]
        sums += [F.count_if(flags[s]).alias(f"entered_{s}"), F.count_if(moved).alias(f"advanced_{s}")]
    totals = visitors.groupBy(*DAY).agg(*sums)
    left = checkouts.where("completed_at is null").groupBy(*DAY).agg(F.count("*").alias("_records"), F.sum("total_minor").alias("_value"))
    zero = F.lit(0).cast("bigint")
    got = lambda name: F.coalesce(F.col(name), zero)
    rows = F.array(*(
        F.struct(
            F.lit(s).alias("stage"), got(f"entered_{s}").alias("entered"), got(f"advanced_{s}").alias("advanced"),
            (got(f"entered_{s}") - got(f"advanced_{s}")).alias("abandoned"),
            (got("_value") if s == 3 else zero).alias("value_minor"), (got("_records") if s == 3 else zero).alias("shopify_records"),
        ) for s, _ in stages
    ))
    return spine.join(totals, [*DAY], "left").join(left, [*DAY], "left").select(*DAY, F.inline(rows))


def _models(spark, name: str = "model") -> DataFrame:
    return small_table(spark, [(m,) for m in MODELS], f"{name} STRING")


def campaign_daily(events: DataFrame, orders: DataFrame, attribution: DataFrame) -> DataFrame:
    """Traffic of each campaign (the same under every model) beside the orders that each model credits to it."""
    campaign = F.coalesce(F.col("campaign_id"), F.lit(0).cast("bigint"))
    counts = (("product_views", PRODUCT), ("atc", CART), ("checkouts_started", CHECKOUT))
    slots = session_slots(
        events.withColumn("campaign_id", campaign), *DAY, "campaign_id", "visitor_key",
        aggregates=tuple(F.count_if(F.col("event_type") == c).alias(n) for n, c in counts),
    )
    sums = ("sessions", *(n for n, _ in counts))
    per_visitor = slots.withColumnRenamed("starts_session", "sessions").groupBy(*DAY, "campaign_id", "visitor_key").agg(*(F.sum(c).alias(c) for c in sums))
    traffic = per_visitor.groupBy(*DAY, "campaign_id").agg(F.count("*").alias("visitors"), *(F.sum(c).alias(c) for c in sums))
    credited = orders.where("cancelled_at is null").join(
        attribution.select("tenant_id", "order_id", "model", campaign.alias("campaign_id")), ["tenant_id", "order_id"]
    )
    key = [*DAY, "model", "campaign_id"]
    buyers = credited.groupBy(*key, "person_id").agg(
        F.count("*").alias("orders"), F.sum("total_minor").alias("revenue_minor"),
        F.max(F.col("order_sequence").isNotNull()).alias("sequenced"), F.max(F.coalesce(F.col("order_sequence") == 1, F.lit(False))).alias("first"),
    )
    known = F.col("person_id").isNotNull()
    sales = buyers.groupBy(*key).agg(
        F.sum("orders").alias("orders"), F.sum("revenue_minor").alias("revenue_minor"),
        F.count_if(known & F.col("first")).alias("new_customers"), F.count_if(known & F.col("sequenced")).alias("_buyers"),
    ).withColumn("returning_customers", F.greatest(F.lit(0), F.col("_buyers") - F.col("new_customers"))).drop("_buyers")
    spread = traffic.join(F.broadcast(_models(events.sparkSession)))
    return spread.join(sales, key, "full").na.fill(0)


def channel_daily(events: DataFrame, orders: DataFrame, attribution: DataFrame, classify) -> DataFrame:
    """``classify`` takes distinct (tenant_id, campaign_id, referrer_id) and adds ``channel``; visitors are summed over such
    pairs and thus an upper bound."""
    pairs = events.select(*DAY, "campaign_id", "referrer_id", "visitor_key").distinct()
    groups = pairs.groupBy(*DAY, "campaign_id", "referrer_id").agg(F.count("*").alias("visitors"))
    named = classify(groups.select("tenant_id", "campaign_id", "referrer_id").distinct())
    same = [F.col("g.tenant_id") == F.col("c.tenant_id"), F.col("g.campaign_id").eqNullSafe(F.col("c.campaign_id")), F.col("g.referrer_id").eqNullSafe(F.col("c.referrer_id"))]
    traffic = groups.alias("g").join(named.alias("c"), same[0] & same[1] & same[2]).select("g.tenant_id", "g.stat_date", "c.channel", "g.visitors")
    traffic = traffic.groupBy(*DAY, "channel").agg(F.sum("visitors").alias("visitors"))
    sales = orders.where("cancelled_at is null").join(attribution.select("tenant_id", "order_id", "model", "channel"), ["tenant_id", "order_id"])
    sales = sales.groupBy(*DAY, "model", F.coalesce("channel", F.lit(DIRECT)).alias("channel")).agg(
        F.count("*").alias("orders"), F.sum("total_minor").alias("revenue_minor")
    )
    spread = traffic.join(F.broadcast(_models(events.sparkSession)))
    return spread.join(sales, [*DAY, "model", "channel"], "full").na.fill(0)


def landing_daily(events: DataFrame, orders: DataFrame, attribution: DataFrame) -> DataFrame:
    """Visitors of each path on any page view of it, beside the orders whose last touch landed there."""
    seen = events.where("path_id is not null").select(*DAY, "path_id", "visitor_key").distinct()
    seen = seen.groupBy(*DAY, "path_id").agg(F.count("*").alias("visitors"))
    landed = attribution.where("model = 'pixel_last' and landing_path_id is not null").select("tenant_id", "order_id", F.col("landing_path_id").alias("path_id"))
    sales = orders.where("cancelled_at is null").join(landed, ["tenant_id", "order_id"])
    sales = sales.groupBy(*DAY, "path_id").agg(F.count("*").alias("orders"), F.sum("total_minor").alias("revenue_minor"))
    return seen.join(sales, [*DAY, "path_id"], "full").na.fill(0)


def product_daily(events: DataFrame, orders: DataFrame, lines: DataFrame, checkouts: DataFrame, checkout_items: DataFrame) -> DataFrame:
    """Views, viewers and carts; purchases, units and revenue; open checkouts that hold the product."""
    key = [*DAY, "product_id"]
    per_visitor = events.where("product_id is not null").groupBy(*key, "visitor_key").agg(
        F.count_if(F.col("event_type") == PRODUCT).alias("views"), F.count_if(F.col("event_type") == CART).alias("atc")
    )
    seen = per_visitor.groupBy(*key).agg(F.sum("views").alias("views"), F.count_if(F.col("views") > 0).alias("viewers"), F.sum("atc").alias("atc"))
    sold = lines.where("product_id is not null").join(orders.where("cancelled_at is null").select("tenant_id", "order_id", "stat_date"), ["tenant_id", "order_id"])
    per_order = sold.groupBy(*key, "order_id").agg(
        F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("price_minor") - F.col("discount_minor")).alias("revenue_minor")
    )
    sold = per_order.groupBy(*key).agg(F.count("*").alias("purchases"), F.sum("units").alias("units"), F.sum("revenue_minor").alias("revenue_minor"))
    held = checkout_items.where("product_id is not null").join(checkouts.where("completed_at is null").select("tenant_id", "checkout_id", "stat_date"), ["tenant_id", "checkout_id"])
    held = held.select(*key, "checkout_id").distinct().groupBy(*key).agg(F.count("*").alias("abandons"))
    return seen.join(sold, key, "full").join(held, key, "full").na.fill(0)


def orders_by_visitor(orders: DataFrame) -> DataFrame:
    valid = orders.where("cancelled_at is null and visitor_key is not null")
    return valid.groupBy(*DAY, "visitor_key").agg(F.count("*").alias("orders"), F.sum("total_minor").alias("revenue_minor"))


def visitor_dimension(events: DataFrame, orders: DataFrame, dimension: str) -> DataFrame:
    """Distinct visitors of each value of ``dimension``; a visitor's orders go to the last value of the day."""
    key = [*DAY, "visitor_key"]
    value = F.coalesce(F.col(dimension), F.lit(0).cast("bigint"))
    moments = events.withColumn("_v", value).groupBy(*key, "_v").agg(F.max(F.struct("occurred_at", "event_uid")).alias("_last"))
    last = moments.groupBy(*key).agg(F.max_by("_v", "_last").alias("_v"))
    sales = orders_by_visitor(orders).join(last, key).groupBy(*DAY, "_v").agg(F.sum("orders").alias("orders"), F.sum("revenue_minor").alias("revenue_minor"))
    return (
        moments.groupBy(*DAY, "_v").agg(F.count("*").alias("visitors")).join(sales, [*DAY, "_v"], "left").na.fill(0, ["orders", "revenue_minor"])
        .withColumnRenamed("_v", dimension)
    )


def geo_daily(events: DataFrame, orders: DataFrame) -> DataFrame:
    return visitor_dimension(events, orders, "geo_id")


def device_daily(events: DataFrame, orders: DataFrame, agents: DataFrame) -> DataFrame:
    """By agent, folded to (device, browser, os); a visitor with two agents of one row counts twice, as defined."""
    by_agent = visitor_dimension(events, orders, "ua_id")
    named = by_agent.join(agents.select("tenant_id", "ua_id", "device_type", "browser", "os"), ["tenant_id", "ua_id"], "left")
    named = named.select(*DAY, F.coalesce("device_type", F.lit(0)).alias("device_type"), F.coalesce("browser", F.lit("")).alias("browser"), F.coalesce("os", F.lit("")).alias("os"), "visitors", "orders", "revenue_minor")
    return named.groupBy(*DAY, "device_type", "browser", "os").agg(*(F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")))


def _first_orders(orders: DataFrame, *more: Column) -> DataFrame:
    valid = orders.where("cancelled_at is null and person_id is not null")
    return valid.groupBy("tenant_id", "person_id").agg(
        F.min("created_at").alias("first_at"), F.min(F.when(F.col("order_sequence") == 2, F.col("created_at"))).alias("next_at"), *more
    )


def _cohorts(first: DataFrame, *keys: str) -> DataFrame:
    """Each person's delay is folded to counts per bucket before any bucket is spread out."""
    month = F.trunc("first_at", "month").alias("cohort_month")
    within = [F.count_if(F.coalesce(F.col("next_at") <= F.col("first_at") + F.expr(f"INTERVAL {d} DAYS"), F.lit(False))).alias(f"in_{d}") for d in COHORT_DAYS]
    sizes = first.groupBy("tenant_id", *keys, month).agg(F.count("*").alias("cohort_size"), *within)
    rows = F.array(*(F.struct(F.lit(d).alias("days_bucket"), F.col(f"in_{d}").alias("reordered")) for d in COHORT_DAYS))
    return sizes.select("tenant_id", *keys, "cohort_month", "cohort_size", F.inline(rows))


def cohort_repeat(orders: DataFrame) -> DataFrame:
    """By UTC month of the first order: size, and persons whose second order came within 30, 60, 90 and 180 days."""
    return _cohorts(_first_orders(orders))


def cohort_campaign(orders: DataFrame, attribution: DataFrame) -> DataFrame:
    """The same, by the campaign of the first touch of the first order (0: none)."""
    first_touch = attribution.where("model = 'pixel_first'").select("tenant_id", "order_id", F.col("campaign_id").alias("_c"))
    joined = orders.join(first_touch, ["tenant_id", "order_id"], "left")
    first = _first_orders(joined, F.min(F.when(F.col("order_sequence") == 1, F.col("_c"))).alias("_c"))
    return _cohorts(first.withColumn("campaign_id", F.coalesce("_c", F.lit(0).cast("bigint"))), "campaign_id")


def person_orders(orders: DataFrame, tenants: DataFrame, now: datetime | str) -> DataFrame:
    """Persons with one, two, three, and four or more orders, as of the store's today."""
    valid = orders.where("cancelled_at is null and person_id is not null")
    counts = valid.groupBy("tenant_id", "person_id").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("tenant_id", F.least("n", F.lit(4)).cast("int").alias("order_count_bucket")).agg(F.count("*").alias("persons"))
    today = local_day(F.lit(now).cast("timestamp"), "iana_timezone").alias("as_of_date")
    return buckets.join(zones(tenants), "tenant_id").select("tenant_id", today, "order_count_bucket", "persons")
