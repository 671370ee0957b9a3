"""Range reports over the rollups. Ratios are null where their denominator is not positive."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import change, divide, percent
from tallyloom.operators.rollups import with_day
from tallyloom.schemas import CAMPAIGN_NUMBER, COHORT_DAYS, DEVICE_NAMES, DIRECT, FACEBOOK_CLICK, FUNNEL_NAMES, GOOGLE_CLICK, NO_CAMPAIGN, OTHER, STAGE_NAMES


def report_range(start: date | None, end: date | None, today: date) -> tuple[date, date, date, date]:
    """(from, to, previous from, previous to): the last 30 days by default, at most 800 days back, ends swapped if reversed."""
    end = end or today
    start = start or end - timedelta(days=29)
    if start > end:
        start, end = end, start
    start = max(start, end - timedelta(days=800))
    days = (end - start).days + 1
    return start, end, start - timedelta(days=days), start - timedelta(days=1)


def within(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.where(F.col("stat_date").between(F.lit(start), F.lit(end)))


def _named(names: dict[int, str], key: Column, otherwise: str) -> Column:
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(otherwise))


def range_buyers(orders: DataFrame, tenants: DataFrame, start: date, end: date) -> DataFrame:
    """Distinct sequenced buyers of the range; new ones had their first order in it."""
    placed = within(with_day(orders.where("cancelled_at is null and person_id is not null"), tenants, "created_at"), start, end)
    people = placed.groupBy("tenant_id", "person_id").agg(
        F.max(F.col("order_sequence").isNotNull()).alias("sequenced"), F.max(F.coalesce(F.col("order_sequence") == 1, F.lit(False))).alias("first")
    )
    sums = people.groupBy("tenant_id").agg(F.count_if("sequenced").alias("buyers"), F.count_if("first").alias("new_buyers"))
    back = F.greatest(F.lit(0), F.col("buyers") - F.col("new_buyers"))
    return sums.withColumn("returning_buyers", back).withColumn("rate", percent("returning_buyers", "buyers"))


SUMMED = ("visitors", "sessions", "pageviews", "orders", "units", "revenue_minor", "refunded_minor", "purchasers")


def report_summary(kpis: DataFrame, orders: DataFrame, tenants: DataFrame, start: date, end: date) -> DataFrame:
    """One row per measure: ``metric, value, change``; both periods are summed in one pass over the rollup."""
    _, _, prev_start, prev_end = report_range(start, end, end)
    now, before = F.col("stat_date").between(F.lit(start), F.lit(end)), F.col("stat_date").between(F.lit(prev_start), F.lit(prev_end))
    sums = [F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double").alias(f"{p}_{c}") for c in SUMMED for p, when in (("now", now), ("before", before))]
    totals = within(kpis, prev_start, end).groupBy("tenant_id").agg(*sums)
    for name, a, b in (("now", start, end), ("before", prev_start, prev_end)):
        people = range_buyers(orders, tenants, a, b).select(
            "tenant_id", *(F.col(c).cast("double").alias(f"{name}_{n}") for c, n in (("buyers", "buyers"), ("new_buyers", "new_customers"), ("returning_buyers", "repeat_customers"), ("rate", "repeat_pct")))
        )
        totals = totals.join(people, "tenant_id", "left").na.fill(0.0, [f"{name}_{c}" for c in ("buyers", "new_customers", "repeat_customers")])
        totals = totals.withColumns({
            f"{name}_aov_minor": divide(f"{name}_revenue_minor", f"{name}_orders"),
            f"{name}_conversion_pct": percent(f"{name}_purchasers", f"{name}_visitors"),
        })
    metrics = [c for c in SUMMED if c != "purchasers"] + ["new_customers", "repeat_customers", "aov_minor", "conversion_pct", "repeat_pct"]
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"now_{m}").alias("value"), change(F.col(f"now_{m}"), F.col(f"before_{m}")).alias("change")) for m in metrics]
    rows.append(F.struct(F.lit("buyers").alias("metric"), F.col("now_buyers").alias("value"), F.lit(None).cast("double").alias("change")))
    return totals.select("tenant_id", F.inline(F.array(*rows)))


def report_trend(kpis: DataFrame, tenants: DataFrame, start: date, end: date) -> DataFrame:
    """Every day of the range; missing ones are zero and flagged."""
    measures = ("visitors", "sessions", "orders", "revenue_minor", "new_customers", "repeat_customers")
    days = tenants.select("tenant_id", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("stat_date"))
    got = within(kpis, start, end).select("tenant_id", "stat_date", *measures, "is_provisional", F.lit(False).alias("missing"))
    joined = days.join(got, ["tenant_id", "stat_date"], "left")
    return joined.select(
        "tenant_id", "stat_date", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in measures),
        (F.coalesce("is_provisional", F.lit(0)) == 1).alias("provisional"), F.coalesce("missing", F.lit(True)).alias("missing"),
    )


def report_funnel(funnel: DataFrame, start: date, end: date) -> DataFrame:
    sums = within(funnel, start, end).groupBy("tenant_id", "step").agg(
        F.sum("reached_visitors").alias("reached"), F.sum("strict_visitors").alias("strict"), F.sum("events").alias("events")
    )
    order = Window.partitionBy("tenant_id").orderBy("step")
    before = F.lag("reached").over(order)
    return sums.select(
        "tenant_id", "step", _named(FUNNEL_NAMES, F.col("step"), "Step").alias("name"), "reached", "strict", "events",
        percent(F.col("reached"), F.first("reached").over(order)).alias("of_first"), percent(F.col("reached"), before).alias("of_prev"),
        F.when(before.isNotNull(), F.greatest(F.lit(0), before - F.col("reached"))).alias("lost"),
    )


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def campaign_name() -> Column:
    """A label from the tags; else from the click id; else the number."""
    parts = [F.when(F.length(c) > 0, clipped(F.col(c), n)) for c, n in (("utm_source", 22), ("utm_medium", 18), ("utm_campaign", 34))]
    label = F.concat_ws(" / ", *parts)
    return (
        F.when(F.col("campaign_id") == 0, NO_CAMPAIGN).when(label != "", label)
        .when(F.col("has_gclid"), GOOGLE_CLICK).when(F.col("has_fbclid"), FACEBOOK_CLICK)
        .otherwise(F.concat(F.lit(CAMPAIGN_NUMBER), F.col("campaign_id").cast("string")))
    )


def _campaign_names(rows: DataFrame, campaigns: DataFrame) -> DataFrame:
    tags = campaigns.select("tenant_id", "campaign_id", "utm_source", "utm_medium", "utm_campaign", "has_gclid", "has_fbclid")
    named = rows.join(tags, ["tenant_id", "campaign_id"], "left").withColumn("name", campaign_name())
    return named.drop("utm_source", "utm_medium", "utm_campaign", "has_gclid", "has_fbclid")


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` of each tenant; the per-group limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def report_campaigns(campaign_rows: DataFrame, campaigns: DataFrame, model: str, start: date, end: date, limit: int = 100) -> DataFrame:
    measures = ("visitors", "sessions", "product_views", "atc", "orders", "revenue_minor", "new_customers", "returning_customers")
    sums = within(campaign_rows, start, end).where(F.col("model") == model).groupBy("tenant_id", "campaign_id").agg(*(F.sum(c).alias(c) for c in measures))
    top = _top(sums, limit, F.desc("revenue_minor"), F.desc("visitors"), F.col("campaign_id"))
    rates = top.withColumns({"aov_minor": divide("revenue_minor", "orders"), "conversion": percent("orders", "visitors"), "atc_rate": percent("atc", "visitors")})
    return _campaign_names(rates, campaigns)


def report_channels(channel_rows: DataFrame, model: str, start: date, end: date) -> DataFrame:
    sums = within(channel_rows, start, end).where(F.col("model") == model).groupBy("tenant_id", "channel").agg(*(F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")))
    return sums.withColumns({"aov_minor": divide("revenue_minor", "orders"), "conversion": percent("orders", "visitors")})


def model_comparison(channel_rows: DataFrame, start: date, end: date) -> DataFrame:
    lost = F.when(F.col("channel").isin(DIRECT, OTHER), F.col("orders")).otherwise(0)
    sums = within(channel_rows, start, end).groupBy("tenant_id", "model").agg(F.sum("orders").alias("orders"), F.sum("revenue_minor").alias("revenue_minor"), F.sum(lost).alias("unattributed"))
    return sums.withColumn("unattributed_pct", percent("unattributed", "orders"))


def report_products(product_rows: DataFrame, products: DataFrame, start: date, end: date, limit: int | None = 100) -> DataFrame:
    """``products``: ``tenant_id, product_id, title``. ``limit=None`` gives all, for the lists below."""
    measures = ("views", "viewers", "atc", "purchases", "units", "revenue_minor", "abandons")
    sums = within(product_rows, start, end).groupBy("tenant_id", "product_id").agg(*(F.sum(c).alias(c) for c in measures))
    if limit is not None:
        sums = _top(sums, limit, F.desc("views"), F.desc("revenue_minor"), F.col("product_id"))
    named = sums.join(products.select("tenant_id", "product_id", "title"), ["tenant_id", "product_id"], "left")
    name = F.coalesce("title", F.concat(F.lit("Product "), F.col("product_id").cast("string")))
    return named.withColumns({"name": name, "view_to_atc": percent("atc", "views"), "view_to_buy": percent("purchases", "views"), "abandon_rate": percent("abandons", "atc")}).drop("title")


def products_most_abandoned(report: DataFrame, limit: int = 15) -> DataFrame:
    return _top(report.where("abandons > 0"), limit, F.desc("abandons"), F.col("product_id"))


def products_leaky(report: DataFrame, least_views: int = 20, below_pct: float = 1.0, limit: int = 10) -> DataFrame:
    return _top(report.where((F.col("views") >= least_views) & (F.col("view_to_buy") < below_pct)), limit, F.desc("views"), F.col("product_id"))


def report_abandonment(stages: DataFrame, start: date, end: date) -> DataFrame:
    """One row per stage, with the headline figures of the whole checkout on each."""
    measures = ("entered", "advanced", "abandoned", "value_minor", "shopify_records")
    sums = within(stages, start, end).groupBy("tenant_id", "stage").agg(*(F.sum(c).alias(c) for c in measures))
    all_of = Window.partitionBy("tenant_id")
    at = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("entered"))).over(all_of), F.lit(0))
    full = sums.withColumns({"started": at(2), "completed": at(7), "records": F.sum("shopify_records").over(all_of), "value_at_risk": F.sum("value_minor").over(all_of)})
    return full.select(
        "tenant_id", "stage", _named(STAGE_NAMES, F.col("stage"), "Stage").alias("name"), "entered", "advanced", "abandoned",
        percent("abandoned", "entered").alias("drop_pct"), "started", "completed", "records", "value_at_risk",
        percent(F.greatest(F.lit(0), F.col("started") - F.col("completed")), F.col("started")).alias("rate"),
    )


def report_repeat(cohorts: DataFrame, today: date, months: int = 12) -> DataFrame:
    """The latest cohort months, buckets across; a bucket that is not over yet is flagged ``too_soon``."""
    latest = F.dense_rank().over(Window.partitionBy("tenant_id").orderBy(F.desc("cohort_month")))
    recent = cohorts.withColumn("_rank", latest).where(F.col("_rank") <= months)
    wide = recent.groupBy("tenant_id", "cohort_month", "cohort_size").pivot("days_bucket", list(COHORT_DAYS)).agg(F.sum("reordered"))
    age = F.datediff(F.lit(today), F.col("cohort_month"))
    return wide.select(
        "tenant_id", "cohort_month", "cohort_size",
        *(c for d in COHORT_DAYS for c in (F.col(str(d)).alias(f"reordered_{d}"), percent(F.col(str(d)), F.col("cohort_size")).alias(f"pct_{d}"), (age < d).alias(f"too_soon_{d}"))),
    )


def order_distribution(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot: persons by number of orders, their share, and the share that bought again."""
    latest = snapshots.groupBy("tenant_id").agg(F.max("as_of_date").alias("as_of_date"))
    rows = snapshots.join(F.broadcast(latest), ["tenant_id", "as_of_date"])
    every = Window.partitionBy("tenant_id")
    total, again = F.sum("persons").over(every), F.sum(F.when(F.col("order_count_bucket") > 1, F.col("persons")).otherwise(0)).over(every)
    return rows.select("tenant_id", "as_of_date", "order_count_bucket", "persons", percent(F.col("persons"), total).alias("share"), percent(again, total).alias("bought_again_pct"))


def campaign_repeat(cohorts: DataFrame, campaigns: DataFrame, bucket: int = 90, limit: int = 25) -> DataFrame:
    sums = cohorts.where(F.col("days_bucket") == bucket).groupBy("tenant_id", "campaign_id").agg(F.sum("cohort_size").alias("cohort_size"), F.sum("reordered").alias("reordered"))
    top = _top(sums.where("cohort_size > 0"), limit, F.desc("cohort_size"), F.col("campaign_id"))
    return _campaign_names(top.withColumn("repeat_pct", percent("reordered", "cohort_size")), campaigns)


def report_geography(geo_rows: DataFrame, places: DataFrame, start: date, end: date, limit: int = 60) -> DataFrame:
    sums = within(geo_rows, start, end).groupBy("tenant_id", "geo_id").agg(*(F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")))
    top = _top(sums, limit, F.desc("revenue_minor"), F.desc("visitors"), F.col("geo_id"))
    named = top.join(places.select("geo_id", "country", "region", "city"), "geo_id", "left")
    label = F.concat_ws(", ", "city", "region", "country")
    return named.withColumns({"name": F.when(label == "", "Unknown").otherwise(label), "conversion": percent("orders", "visitors")}).drop("country", "region", "city")


def report_devices(device_rows: DataFrame, start: date, end: date) -> DataFrame:
    sums = within(device_rows, start, end).groupBy("tenant_id", "device_type").agg(*(F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")))
    return sums.withColumns({"name": _named(DEVICE_NAMES, F.col("device_type"), "Unknown"), "conversion": percent("orders", "visitors")})


def report_landing(landing_rows: DataFrame, paths: DataFrame, start: date, end: date, limit: int = 40) -> DataFrame:
    sums = within(landing_rows, start, end).groupBy("tenant_id", "path_id").agg(*(F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")))
    top = _top(sums, limit, F.desc("visitors"), F.col("path_id"))
    named = top.join(paths.select("tenant_id", "path_id", "path"), ["tenant_id", "path_id"], "left")
    return named.withColumns({"name": F.coalesce("path", F.concat(F.lit("#"), F.col("path_id").cast("string"))), "conversion": percent("orders", "visitors")}).drop("path")


def store_stats(tenants: DataFrame, events: DataFrame, orders: DataFrame, kpis: DataFrame) -> DataFrame:
    """What a store has: events, their last time, visitors, orders, revenue, and whether anything is rolled up yet."""
    per_visitor = events.groupBy("tenant_id", "visitor_key").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last"))
    seen = per_visitor.groupBy("tenant_id").agg(F.sum("n").alias("events"), F.max("last").alias("last_event_at"), F.count("*").alias("visitors"))
    sold = orders.where("cancelled_at is null").groupBy("tenant_id").agg(F.count("*").alias("orders"), F.sum("total_minor").alias("revenue_minor"))
    ready = kpis.select("tenant_id").distinct().withColumn("has_data", F.lit(True))
    joined = tenants.select("tenant_id").join(seen, "tenant_id", "left").join(sold, "tenant_id", "left").join(ready, "tenant_id", "left")
    return joined.na.fill(0, ["events", "visitors", "orders", "revenue_minor"]).na.fill(False, ["has_data"])
