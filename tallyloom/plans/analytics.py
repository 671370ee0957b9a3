"""Registered queries: rollups, attribution, cohorts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.small import small_table
from tallyloom.operators import attribution as at
from tallyloom.operators import identity, metrics_extra, reports, rollups
from tallyloom.plans import common as c
from tallyloom.plans.cte import channel_case, pct, ratio, sql
from tallyloom.plans.lineage import folder_of
from tallyloom.plans.registry import query
from tallyloom.schemas import CAMPAIGN_NUMBER, DEFAULT_RULES, FACEBOOK_CLICK, FUNNEL_NAMES, GOOGLE_CLICK, NO_CAMPAIGN, STAGE_NAMES
from tallyloom.sources import adapters as ad
from tallyloom.sources.files import read_table
from tallyloom.sources.sinks import sink_events

A = "stat_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-25'"
A0 = "stat_date BETWEEN DATE '2023-12-27' AND DATE '2024-01-10'"
C = "stat_date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'"


def _sum(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


def _names(key: str, names: dict[int, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


# --- daily rollups ---------------------------------------------------------------------------------------------------

query("day_spine", sql("SELECT * FROM spine", "spine"))(c.spine)
query("kpi_daily", sql("SELECT * FROM kpi", "kpi"))(c.kpi)
query("sessions_daily", sql("SELECT tenant_id, stat_date, CAST(sum(starts) AS BIGINT) AS sessions FROM marked GROUP BY 1, 2", "marked"))(lambda s, d: rollups.sessions_daily(c.ev(s, d)))
query("sessions_by_campaign", sql("SELECT tenant_id, stat_date, campaign_id, CAST(sum(starts) AS BIGINT) AS sessions FROM marked_c GROUP BY 1, 2, 3", "marked_c"))(lambda s, d: rollups.sessions_by_campaign(c.ev(s, d)))
query("funnel_daily", sql("SELECT tenant_id, stat_date, step, reached_visitors, strict_visitors, events FROM funnel", "funnel"))(lambda s, d: rollups.funnel_daily(c.spine(s, d), c.vd(s, d)))
query("abandon_daily", sql("SELECT * FROM stages", "stages"))(lambda s, d: rollups.abandon_daily(c.spine(s, d), c.vd(s, d), c.open_checkouts(c.ob(s, d), "order_id % 5 = 0")))
query("campaign_daily", sql("SELECT * FROM campaign_rows", "campaign_rows"))(c.campaign_rows)
query("channel_daily", sql("SELECT * FROM channel_rows", "channel_rows"))(c.channel_rows)


@query("landing_daily", sql("SELECT * FROM landing_rows", "landing_rows"))
def landing_rows(s, d):
    return rollups.landing_daily(c.ev(s, d), c.ob(s, d), c.attr(s, d))


query("product_daily", sql("SELECT * FROM product_rows", "product_rows"))(c.product_rows)
query("orders_by_visitor", sql("SELECT * FROM ov", "ov"))(lambda s, d: rollups.orders_by_visitor(c.ob(s, d)))


@query("geo_daily", sql("SELECT * FROM geo_rows", "geo_rows"))
def geo_rows(s, d):
    return rollups.geo_daily(c.ev(s, d), c.ob(s, d))


@query("device_daily", sql("SELECT * FROM device_rows", "device_rows"))
def device_rows(s, d):
    return rollups.device_daily(c.ev(s, d), c.ob(s, d), ad.dim_useragent(s))


_CHECKED = {"kpi": ("kpi", "pageviews"), "funnel": ("funnel", "events"), "campaign": ("campaign_rows", "sessions"), "channel": ("channel_rows", "revenue_minor"), "landing": ("landing_rows", "visitors"), "geo": ("geo_rows", "revenue_minor"), "device": ("device_rows", "visitors"), "abandon": ("stages", "entered")}
_DAILY = " UNION ALL ".join(f"SELECT '{n}' AS rollup, stat_date, count(*) AS n_rows, CAST(sum({m}) AS BIGINT) AS total FROM {t} GROUP BY stat_date" for n, (t, m) in _CHECKED.items())


@query("daily_rollups", sql(_DAILY, *(t for t, _ in _CHECKED.values())))
def daily_rollups(s, d):
    """Rows of each day of the daily rollups that one job makes, and the sum of one measure (product_daily has a query of its own)."""
    made = c.daily_rollups(s, d)
    counted = [made[n].groupBy("stat_date").agg(F.count("*").alias("n_rows"), F.sum(m).cast("bigint").alias("total")).select(F.lit(n).alias("rollup"), "stat_date", "n_rows", "total") for n, (_, m) in _CHECKED.items()]
    return reduce(DataFrame.unionByName, counted)


@query("days_from", "SELECT 1 AS tenant_id, CAST(d AS DATE) AS stat_date FROM generate_series((SELECT CAST(min(ts) AS DATE) FROM events), DATE '2024-01-31', INTERVAL 1 DAY) t(d)")
def days_from(s, d):
    first = ad.events(s, d).agg(F.to_date(F.min("occurred_at")).cast("string")).first()[0] or "2024-01-31"
    return rollups.days_from(c.store(s), first, ad.NOW_EVENTS)


# --- cohorts ---------------------------------------------------------------------------------------------------------

query("order_sequence", sql("SELECT tenant_id, order_id, person_id, order_sequence FROM oc", "oc"), dates=())(lambda s, d: identity.order_sequence(ad.star_orders(s, d), c.store(s)).select("tenant_id", "order_id", "person_id", "order_sequence"))


@query("cohort_repeat", sql("SELECT * FROM cohorts", "cohorts"), dates=("cohort_month",))
def cohorts(s, d):
    return rollups.cohort_repeat(c.oc(s, d))


@query("cohort_campaign", sql("SELECT * FROM cohorts_c", "cohorts_c"), dates=("cohort_month",))
def campaign_cohorts(s, d):
    orders = c.oc(s, d)
    return rollups.cohort_campaign(orders, c.first_touch(orders))


_PERSON = "SELECT 1 AS tenant_id, DATE '2001-09-01' AS as_of_date, CAST(least(n, 4) AS INT) AS order_count_bucket, count(*) AS persons FROM (SELECT person_id, count(*) AS n FROM oc WHERE cancelled_at IS NULL GROUP BY 1) GROUP BY 3"


@query("person_orders", sql(_PERSON, "oc"), dates=("as_of_date",))
def person_orders(s, d):
    return rollups.person_orders(c.oc(s, d), c.store(s), ad.NOW_ORDERS)


query("persons", sql("SELECT tenant_id, person_id, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, count(*) AS orders FROM oc GROUP BY 1, 2", "oc"), dates=())(lambda s, d: identity.persons(ad.star_orders(s, d)))

# --- attribution -----------------------------------------------------------------------------------------------------

_HALF = "SELECT * FROM attr WHERE model = 'pixel_last' AND order_id % 2 = 0"


@query("attr_pending", sql(
    f"""SELECT o.tenant_id, o.order_id, o.created_at, o.visitor_key, o.person_id FROM ob o LEFT JOIN ({_HALF}) a USING (order_id)
WHERE o.created_at < TIMESTAMP '2024-01-29 00:00:00' AND (a.model IS NULL OR (a.campaign_id IS NULL AND o.created_at > TIMESTAMP '2024-01-26 02:00:00'))
ORDER BY o.created_at, o.order_id LIMIT 500""", "ob", "attr"), dates=())  # fmt: skip
def attr_pending(s, d):
    half = c.unclassified(s, d).where("model = 'pixel_last' and order_id % 2 = 0")
    return at.attr_pending(ad.event_orders(s, d), half, "2024-01-29 02:00:00")


@query("attr_visitor_set", sql("SELECT DISTINCT tenant_id, order_id, created_at, visitor_key FROM ob", "ob"), dates=())
def attr_visitor_set(s, d):
    return at.attr_visitor_set(ad.event_orders(s, d), c.visitors(s, d))


@query("attr_touches", sql("SELECT t.* FROM touch t WHERE visitor_key IN (SELECT visitor_key FROM ob)", "touch", "ob"), dates=())
def attr_touches(s, d):
    return at.attr_touches(ad.events(s, d), at.attr_visitor_set(ad.event_orders(s, d), c.visitors(s, d)))


query("attr_pixel_first_last", sql("SELECT * FROM pixel", "pixel"), dates=())(c.pixel)


@query("attr_incremental", sql("SELECT * FROM pixel", "pixel"), dates=())
def attr_incremental(s, d):
    """Two runs, the second with orders that the first could not have: each reads the days of its due orders only."""
    folder = folder_of(s)
    sink_events(ad.events(s, d), f"{folder}/events")
    stored, orders = read_table(s, f"{folder}/events", ad.events(s, d)), ad.event_orders(s, d)
    rows = c.pixel(s, d).limit(0)
    for now in ("2024-01-15 00:00:00", "2024-02-15 00:00:00"):
        rows = at.attr_resolve_due(orders.where(F.col("created_at") < F.lit(now).cast("timestamp")), rows, stored, c.visitors(s, d), now)
        rows.write.parquet(f"{folder}/rows/{now[:10]}")
        rows = s.read.parquet(f"{folder}/rows/{now[:10]}")
    return rows


_TRIPLES = "SELECT DISTINCT tenant_id, campaign_id, referrer_id, path_id FROM ev"


@query("channel_classify", sql(f"SELECT t.*, {channel_case()} AS channel FROM ({_TRIPLES}) t LEFT JOIN camp USING (campaign_id) LEFT JOIN refs USING (referrer_id)".replace("SELECT t.*", "SELECT t.tenant_id, t.campaign_id, t.referrer_id, t.path_id"), "ev", "camp", "refs"), dates=())
def channel_classify(s, d):
    triples = ad.events(s, d).select(*at.TRIPLE).distinct()
    return at.channel_classify(triples, ad.rules(s), *c.dims(s))


query("channel_backfill", sql("SELECT tenant_id, order_id, model, campaign_id, referrer_id, landing_path_id, touch_at, channel FROM attr", "attr"), dates=())(c.attr)

_NEW_RULES = [r for r in DEFAULT_RULES if r[0] not in (13, 40)] + [(9, "utm_source", "equals", "partner", "Affiliate")]
_NEW_RULES.sort()


def _proposed(s):
    return small_table(s, [(1, *r, True) for r in _NEW_RULES], ad.rules(s).schema)


def _case(rules) -> str:
    return channel_case(rules).replace("lower(coalesce(utm_source, '')) = '' THEN 'Affiliate'", "lower(coalesce(utm_source, '')) = 'partner' THEN 'Affiliate'")


_MOVED = f"SELECT a.*, {_case(_NEW_RULES)} AS fresh FROM attr a LEFT JOIN camp USING (campaign_id) LEFT JOIN refs USING (referrer_id)"


@query("channel_reclassify", sql(f"SELECT tenant_id, order_id, model, campaign_id, referrer_id, landing_path_id, touch_at, fresh AS channel, channel IS DISTINCT FROM fresh AS changed FROM ({_MOVED})", "attr", "camp", "refs"), dates=())
def channel_reclassify(s, d):
    return at.channel_reclassify(c.attr(s, d), _proposed(s), *c.dims(s))


@query("channel_preview", sql(f"SELECT tenant_id, channel AS from_channel, fresh AS to_channel, count(*) AS moved FROM ({_MOVED}) WHERE channel IS DISTINCT FROM fresh GROUP BY 1, 2, 3", "attr", "camp", "refs"), dates=())
def channel_preview(s, d):
    return at.channel_preview(c.attr(s, d), _proposed(s), *c.dims(s))


_RULE_VALUES = ", ".join(f"({p}, '{f}', '{o}', {'NULL' if v is None else repr(v)}, '{n}')" for p, f, o, v, n in DEFAULT_RULES)


@query("channel_rules_seed", f"SELECT CAST(t.tenant_id AS INT) AS tenant_id, r.*, true AS enabled FROM (SELECT DISTINCT user_id + 1 AS tenant_id FROM events) t CROSS JOIN (SELECT * FROM (VALUES {_RULE_VALUES}) v(priority, match_field, match_op, match_value, channel)) r WHERE NOT (t.tenant_id % 2 = 0 AND r.priority < 20)", dates=())
def channel_rules_seed(s, d):
    stores = ad.events(s, d).select((F.col("visitor_key") + 1).cast("int").alias("tenant_id")).distinct()
    own = stores.where("tenant_id % 2 = 0").join(F.broadcast(at.default_rules(s).where("priority < 20").drop("tenant_id")))
    rules = at.default_rules(s).unionByName(own.select(*at.default_rules(s).columns))
    return at.channel_rules_seed(rules, stores)


@query("channel_rename", sql(f"SELECT tenant_id, stat_date, model, CASE WHEN channel = 'Email' THEN 'Other' ELSE channel END AS channel, {_sum('visitors', 'orders', 'revenue_minor')} FROM channel_rows GROUP BY 1, 2, 3, 4", "channel_rows"))
def channel_rename(s, d):
    return at.channel_rename(c.channel_rows(s, d), "Email", "Other")


@query("attr_disagreement", sql(
    f"""SELECT *, {pct('agree', 'comparable')} AS agree_pct FROM (SELECT o.tenant_id, count(*) AS orders, count(*) FILTER (p.channel IS NOT NULL AND s.channel IS NOT NULL) AS comparable,
count(*) FILTER (p.channel = s.channel) AS agree, count(*) FILTER (p.channel IS NULL OR p.channel = 'Direct/Untracked') AS pixel_blind, count(*) FILTER (s.channel IS NULL OR s.channel = 'Direct/Untracked') AS shopify_blind
FROM ob o LEFT JOIN (SELECT * FROM attr WHERE model = 'pixel_last') p USING (order_id) LEFT JOIN (SELECT * FROM attr WHERE model = 'shopify_last') s USING (order_id)
WHERE o.created_at >= TIMESTAMP '2024-01-05 00:00:00' AND o.created_at < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1)""", "ob", "attr"), dates=())  # fmt: skip
def attr_disagreement(s, d):
    return at.attr_disagreement(ad.event_orders(s, d), c.attr(s, d), "2024-01-05 00:00:00", "2024-01-25 00:00:00")


# --- reports ---------------------------------------------------------------------------------------------------------

_BUYERS = "(SELECT count(DISTINCT CASE WHEN order_sequence IS NOT NULL THEN person_id END) AS buyers, count(DISTINCT CASE WHEN order_sequence = 1 THEN person_id END) AS fresh FROM {t} WHERE cancelled_at IS NULL AND person_id IS NOT NULL AND {w})"


@query("range_buyers", sql(f"SELECT 1 AS tenant_id, buyers, fresh AS new_buyers, greatest(0, buyers - fresh) AS returning_buyers, {pct('greatest(0, buyers - fresh)', 'buyers')} AS rate FROM {_BUYERS.format(t='oc', w=C)}", "oc"), dates=())
def range_buyers(s, d):
    return reports.range_buyers(identity.order_sequence(ad.star_orders(s, d), c.store(s)), c.store(s), c.C_START, c.C_END)


def _change(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN round((({a}) - ({b})) / abs({b}) * 100, 1) END"


_TOTALS = "SELECT " + ", ".join(f"CAST(coalesce(sum(CASE WHEN {w} THEN {m} END), 0) AS DOUBLE) AS {p}_{m}" for m in reports.SUMMED for p, w in (("n", A), ("b", A0))) + " FROM kpi"
_METRICS = {m: (f"n_{m}", f"b_{m}") for m in reports.SUMMED if m != "purchasers"}
_METRICS |= {"new_customers": ("CAST(bn.fresh AS DOUBLE)", "CAST(bb.fresh AS DOUBLE)"), "repeat_customers": ("CAST(greatest(0, bn.buyers - bn.fresh) AS DOUBLE)", "CAST(greatest(0, bb.buyers - bb.fresh) AS DOUBLE)")}
_METRICS |= {"aov_minor": (ratio("n_revenue_minor", "n_orders"), ratio("b_revenue_minor", "b_orders")), "conversion_pct": (pct("n_purchasers", "n_visitors"), pct("b_purchasers", "b_visitors"))}
_METRICS |= {"repeat_pct": (pct("greatest(0, bn.buyers - bn.fresh)", "bn.buyers"), pct("greatest(0, bb.buyers - bb.fresh)", "bb.buyers"))}
_SUMMARY = " UNION ALL ".join([f"SELECT 1 AS tenant_id, '{m}' AS metric, {a} AS value, {_change(a, b)} AS change FROM tot, bn, bb" for m, (a, b) in _METRICS.items()] + ["SELECT 1, 'buyers', CAST(bn.buyers AS DOUBLE), NULL FROM bn"])


@query("report_summary", sql(f"SELECT * FROM (WITH tot AS ({_TOTALS}), bn AS {_BUYERS.format(t='ob', w=A)}, bb AS {_BUYERS.format(t='ob', w=A0)} {_SUMMARY})", "kpi", "ob"), dates=())
def report_summary(s, d):
    return reports.report_summary(c.kpi(s, d), identity.order_sequence(ad.event_orders(s, d), c.store(s)), c.store(s), c.START, c.END)


_TREND = ("visitors", "sessions", "orders", "revenue_minor", "new_customers", "repeat_customers")


@query("report_trend", sql(
    "SELECT 1 AS tenant_id, CAST(d AS DATE) AS stat_date, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in _TREND)
    + ", coalesce(is_provisional, 0) = 1 AS provisional, k.stat_date IS NULL AS missing FROM generate_series(DATE '2024-01-20', DATE '2024-02-05', INTERVAL 1 DAY) t(d) LEFT JOIN kpi k ON k.stat_date = CAST(d AS DATE)", "kpi"))
def report_trend(s, d):
    from datetime import date

    return reports.report_trend(c.kpi(s, d), c.store(s), date(2024, 1, 20), date(2024, 2, 5))


@query("report_funnel", sql(
    f"""SELECT tenant_id, step, {_names('step', FUNNEL_NAMES)} AS name, reached, strict, events, {pct('reached', 'first_value(reached) OVER (ORDER BY step)')} AS of_first,
{pct('reached', 'lag(reached) OVER (ORDER BY step)')} AS of_prev, CASE WHEN lag(reached) OVER (ORDER BY step) IS NOT NULL THEN greatest(0, lag(reached) OVER (ORDER BY step) - reached) END AS lost
FROM (SELECT tenant_id, step, CAST(sum(reached_visitors) AS BIGINT) AS reached, CAST(sum(strict_visitors) AS BIGINT) AS strict, CAST(sum(events) AS BIGINT) AS events FROM funnel WHERE {A} GROUP BY 1, 2)""", "funnel"), dates=())  # fmt: skip
def report_funnel(s, d):
    return reports.report_funnel(rollups.funnel_daily(c.spine(s, d), c.vd(s, d)), c.START, c.END)


_LABEL = "concat_ws(' / ', utm_source, utm_medium, utm_campaign)"
_CAMPAIGN_NAME = f"CASE WHEN r.campaign_id = 0 THEN '{NO_CAMPAIGN}' WHEN {_LABEL} <> '' THEN {_LABEL} WHEN has_gclid THEN '{GOOGLE_CLICK}' WHEN has_fbclid THEN '{FACEBOOK_CLICK}' ELSE '{CAMPAIGN_NUMBER}' || r.campaign_id END AS name"


@query("report_campaigns", sql(
    f"""SELECT r.*, {ratio('revenue_minor', 'orders')} AS aov_minor, {pct('orders', 'visitors')} AS conversion, {pct('atc', 'visitors')} AS atc_rate, {_CAMPAIGN_NAME}
FROM (SELECT tenant_id, campaign_id, {_sum('visitors', 'sessions', 'product_views', 'atc', 'orders', 'revenue_minor', 'new_customers', 'returning_customers')} FROM campaign_rows WHERE model = 'pixel_last' AND {A} GROUP BY 1, 2
  ORDER BY sum(revenue_minor) DESC, sum(visitors) DESC, campaign_id LIMIT 100) r LEFT JOIN camp c ON c.campaign_id = r.campaign_id""", "campaign_rows", "camp"), dates=())  # fmt: skip
def report_campaigns(s, d):
    return reports.report_campaigns(c.campaign_rows(s, d), ad.dim_campaign(s), "pixel_last", c.START, c.END)


@query("report_channels", sql(f"SELECT *, {ratio('revenue_minor', 'orders')} AS aov_minor, {pct('orders', 'visitors')} AS conversion FROM (SELECT tenant_id, channel, {_sum('visitors', 'orders', 'revenue_minor')} FROM channel_rows WHERE model = 'pixel_first' AND {A} GROUP BY 1, 2)", "channel_rows"), dates=())
def report_channels(s, d):
    return reports.report_channels(c.channel_rows(s, d), "pixel_first", c.START, c.END)


@query("model_comparison", sql(f"SELECT *, {pct('unattributed', 'orders')} AS unattributed_pct FROM (SELECT tenant_id, model, {_sum('orders', 'revenue_minor')}, CAST(sum(CASE WHEN channel IN ('Direct/Untracked', 'Other') THEN orders ELSE 0 END) AS BIGINT) AS unattributed FROM channel_rows WHERE {A} GROUP BY 1, 2)", "channel_rows"), dates=())
def model_comparison(s, d):
    return reports.model_comparison(c.channel_rows(s, d), c.START, c.END)


# products seen in events, bought in purchases: both sides of adapter A
_PROD = f"""SELECT tenant_id, product_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(viewers) AS BIGINT) AS viewers, CAST(sum(atc) AS BIGINT) AS atc, CAST(sum(purchases) AS BIGINT) AS purchases, CAST(sum(units) AS BIGINT) AS units, CAST(sum(revenue) AS BIGINT) AS revenue_minor, CAST(sum(abandons) AS BIGINT) AS abandons FROM (
SELECT tenant_id, stat_date, product_id, count(*) FILTER (event_type = 3) AS views, count(DISTINCT CASE WHEN event_type = 3 THEN visitor_key END) AS viewers, count(*) FILTER (event_type = 6) AS atc, 0 AS purchases, 0 AS units, 0 AS revenue, 0 AS abandons FROM ev WHERE product_id IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT o.tenant_id, o.stat_date, l.product_id, 0, 0, 0, count(DISTINCT o.order_id), sum(l.quantity), sum(l.quantity * 100 - 10), 0 FROM lb l JOIN ob o USING (order_id) WHERE cancelled_at IS NULL GROUP BY 1, 2, 3
UNION ALL SELECT o.tenant_id, o.stat_date, l.product_id, 0, 0, 0, 0, 0, 0, count(DISTINCT o.order_id) FROM lb l JOIN open_b b ON b.checkout_id = l.order_id JOIN ob o USING (order_id) GROUP BY 1, 2, 3) WHERE {A} GROUP BY 1, 2"""
_PROD_NAMED = f"SELECT r.*, coalesce(p_name, 'Product ' || product_id) AS name, {pct('atc', 'views')} AS view_to_atc, {pct('purchases', 'views')} AS view_to_buy, {pct('abandons', 'atc')} AS abandon_rate FROM ({_PROD}) r LEFT JOIN part ON p_partkey = product_id"


def _products(s, d, limit):
    orders, lines = c.ob(s, d), ad.event_lines(s, d)
    priced = lines.withColumns({"price_minor": F.lit(100), "discount_minor": F.lit(10)})
    left = c.open_checkouts(orders, "order_id % 5 = 0")
    items = lines.select("tenant_id", F.col("order_id").alias("checkout_id"), "product_id")
    rows = rollups.product_daily(c.ev(s, d), orders, priced, left, items)
    titles = ad.table(s, d, "part").select(F.lit(1).alias("tenant_id"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"))
    return reports.report_products(rows, titles, c.START, c.END, limit)


query("report_products", sql(f"SELECT * FROM ({_PROD_NAMED}) ORDER BY views DESC, revenue_minor DESC, product_id LIMIT 100", "ev", "lb", "ob", "open_b"), dates=())(lambda s, d: _products(s, d, 100))
query("products_most_abandoned", sql(f"SELECT * FROM ({_PROD_NAMED}) WHERE abandons > 0 ORDER BY abandons DESC, product_id LIMIT 15", "ev", "lb", "ob", "open_b"), dates=())(lambda s, d: reports.products_most_abandoned(_products(s, d, None)))
query("products_leaky", sql(f"SELECT * FROM ({_PROD_NAMED}) WHERE views >= 5 AND view_to_buy < 60 ORDER BY views DESC, product_id LIMIT 10", "ev", "lb", "ob", "open_b"), dates=())(lambda s, d: reports.products_leaky(_products(s, d, None), least_views=5, below_pct=60.0))


@query("report_abandonment", sql(
    f"""SELECT tenant_id, stage, {_names('stage', STAGE_NAMES)} AS name, entered, advanced, abandoned, {pct('abandoned', 'entered')} AS drop_pct, started, completed, records, value_at_risk, {pct('greatest(0, started - completed)', 'started')} AS rate
FROM (SELECT *, max(CASE WHEN stage = 2 THEN entered END) OVER () AS started, max(CASE WHEN stage = 7 THEN entered END) OVER () AS completed, CAST(sum(shopify_records) OVER () AS BIGINT) AS records, CAST(sum(value_minor) OVER () AS BIGINT) AS value_at_risk
FROM (SELECT tenant_id, stage, {_sum('entered', 'advanced', 'abandoned', 'value_minor', 'shopify_records')} FROM stages WHERE {A} GROUP BY 1, 2))""", "stages"), dates=())  # fmt: skip
def report_abandonment(s, d):
    rows = rollups.abandon_daily(c.spine(s, d), c.vd(s, d), c.open_checkouts(c.ob(s, d), "order_id % 5 = 0"))
    return reports.report_abandonment(rows, c.START, c.END)


@query("report_repeat", sql(
    "SELECT tenant_id, cohort_month, cohort_size, " + ", ".join(f"CAST(sum(CASE WHEN days_bucket = {n} THEN reordered END) AS BIGINT) AS reordered_{n}, {pct(f'sum(CASE WHEN days_bucket = {n} THEN reordered END)', 'cohort_size')} AS pct_{n}, date_diff('day', cohort_month, DATE '2001-09-01') < {n} AS too_soon_{n}" for n in (30, 60, 90, 180))
    + " FROM cohorts WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM cohorts ORDER BY 1 DESC LIMIT 12) GROUP BY 1, 2, 3", "cohorts"), dates=("cohort_month",))
def report_repeat(s, d):
    return reports.report_repeat(cohorts(s, d), c.C_TODAY)


@query("order_distribution", sql(f"SELECT *, {pct('persons', 'sum(persons) OVER ()')} AS share, {pct('sum(CASE WHEN order_count_bucket > 1 THEN persons ELSE 0 END) OVER ()', 'sum(persons) OVER ()')} AS bought_again_pct FROM ({_PERSON})", "oc"), dates=("as_of_date",))
def order_distribution(s, d):
    return reports.order_distribution(person_orders(s, d))


@query("campaign_repeat", sql(f"SELECT r.*, {pct('reordered', 'cohort_size')} AS repeat_pct, {_CAMPAIGN_NAME} FROM (SELECT tenant_id, campaign_id, {_sum('cohort_size', 'reordered')} FROM cohorts_c WHERE days_bucket = 90 GROUP BY 1, 2 HAVING sum(cohort_size) > 0 ORDER BY sum(cohort_size) DESC, campaign_id LIMIT 25) r LEFT JOIN camp c ON c.campaign_id = r.campaign_id", "cohorts_c", "camp"), dates=())
def campaign_repeat(s, d):
    return reports.campaign_repeat(campaign_cohorts(s, d), ad.dim_campaign(s))


_PLACE = "concat_ws(', ', CASE WHEN geo_id < 9 AND geo_id % 4 <> 0 THEN 'city' || geo_id END, CASE WHEN geo_id < 9 AND geo_id % 3 <> 0 THEN 'region' || geo_id END, CASE WHEN geo_id < 9 THEN CASE WHEN geo_id % 2 = 0 THEN 'in' ELSE 'us' END END)"


@query("report_geography", sql(f"SELECT *, CASE WHEN {_PLACE} = '' THEN 'Unknown' ELSE {_PLACE} END AS name, {pct('orders', 'visitors')} AS conversion FROM (SELECT tenant_id, geo_id, {_sum('visitors', 'orders', 'revenue_minor')} FROM geo_rows WHERE {A} GROUP BY 1, 2 ORDER BY sum(revenue_minor) DESC, sum(visitors) DESC, geo_id LIMIT 60)", "geo_rows"), dates=())
def report_geography(s, d):
    return reports.report_geography(geo_rows(s, d), ad.dim_geo(s), c.START, c.END)


@query("report_devices", sql(f"SELECT *, {_names('device_type', {0: 'Unknown', 1: 'Mobile', 2: 'Desktop', 3: 'Tablet', 4: 'Bot'})} AS name, {pct('orders', 'visitors')} AS conversion FROM (SELECT tenant_id, device_type, {_sum('visitors', 'orders', 'revenue_minor')} FROM device_rows WHERE {A} GROUP BY 1, 2)", "device_rows"), dates=())
def report_devices(s, d):
    return reports.report_devices(device_rows(s, d), c.START, c.END)


@query("report_landing", sql(f"SELECT r.*, coalesce(path, '#' || r.path_id) AS name, {pct('orders', 'visitors')} AS conversion FROM (SELECT tenant_id, path_id, {_sum('visitors', 'orders', 'revenue_minor')} FROM landing_rows WHERE {A} GROUP BY 1, 2 ORDER BY sum(visitors) DESC, path_id LIMIT 40) r LEFT JOIN paths p ON p.path_id = r.path_id", "landing_rows", "paths"), dates=())
def report_landing(s, d):
    return reports.report_landing(landing_rows(s, d), ad.dim_path(s), c.START, c.END)


@query("store_stats", sql("SELECT 1 AS tenant_id, (SELECT count(*) FROM ev) AS events, (SELECT max(occurred_at) FROM ev) AS last_event_at, (SELECT count(DISTINCT visitor_key) FROM ev) AS visitors, (SELECT count(*) FROM ob WHERE cancelled_at IS NULL) AS orders, (SELECT CAST(sum(total_minor) AS BIGINT) FROM ob WHERE cancelled_at IS NULL) AS revenue_minor, true AS has_data", "ev", "ob"), dates=())
def store_stats(s, d):
    return reports.store_stats(c.store(s), ad.events(s, d), ad.event_orders(s, d), c.kpi(s, d))


# --- further metrics -------------------------------------------------------------------------------------------------


def _left(entered: int, done: int, label: str) -> str:
    return sql(f"""SELECT *, {pct('abandoned', label)} AS abandon_pct FROM (SELECT tenant_id, stat_date, count(*) AS {label}, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_type = {done} AND e.visitor_key = f.visitor_key AND e.occurred_at BETWEEN f.at AND f.at + INTERVAL 24 HOUR)) AS abandoned
FROM (SELECT tenant_id, stat_date, visitor_key, min(occurred_at) AS at FROM ev WHERE event_type = {entered} GROUP BY 1, 2, 3) f GROUP BY 1, 2)""", "ev")


query("cart_abandonment", _left(6, 8, "carted"))(lambda s, d: metrics_extra.cart_abandonment(c.ev(s, d)))
query("checkout_abandonment", _left(8, 13, "started"))(lambda s, d: metrics_extra.checkout_abandonment(c.ev(s, d)))
query("express_checkout", sql(f"SELECT *, {pct('express_visitors', 'checkout_visitors')} AS express_pct FROM (SELECT tenant_id, stat_date, count(*) FILTER (n_8 > 0) AS checkout_visitors, count(*) FILTER (n_8 > 0 AND n_6 = 0) AS express_visitors FROM vd GROUP BY 1, 2)", "vd"))(lambda s, d: metrics_extra.express_checkout(c.vd(s, d)))
query("days_between_orders", sql("SELECT tenant_id, count(*) AS pairs, quantile_cont(gap, 0.5) AS median_days, round(avg(gap), 4) AS mean_days FROM (SELECT tenant_id, (epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY person_id ORDER BY created_at, order_id))) / 86400 AS gap FROM oc WHERE cancelled_at IS NULL) WHERE gap IS NOT NULL GROUP BY 1", "oc"), dates=())(lambda s, d: metrics_extra.days_between_orders(ad.star_orders(s, d)))
query("unattributed_split", sql("SELECT a.tenant_id, model, CASE WHEN coalesce(has_gclid OR has_fbclid, false) THEN 'recoverable' ELSE 'unknown' END AS kind, count(*) AS orders FROM attr a LEFT JOIN camp USING (campaign_id) WHERE coalesce(channel, 'Direct/Untracked') = 'Direct/Untracked' GROUP BY 1, 2, 3", "attr", "camp"), dates=())(lambda s, d: metrics_extra.unattributed_split(c.attr(s, d), ad.dim_campaign(s)))


@query("path_to_purchase", sql("SELECT tenant_id, CAST(order_id % 9 AS INT) AS days_to_conversion, CAST(order_id % 4 AS INT) AS moments_count, count(*) AS orders FROM ob WHERE cancelled_at IS NULL GROUP BY 1, 2, 3", "ob"), dates=())
def path_to_purchase(s, d):
    orders = ad.event_orders(s, d).withColumns({"days_to_conversion": (F.col("order_id") % 9).cast("int"), "moments_count": (F.col("order_id") % 4).cast("int")})
    return metrics_extra.path_to_purchase(orders)


query("net_revenue", sql("SELECT tenant_id, stat_date, revenue_minor, refunded_minor, revenue_minor - refunded_minor AS net_minor FROM kpi", "kpi"))(lambda s, d: metrics_extra.net_revenue(c.kpi(s, d)))
