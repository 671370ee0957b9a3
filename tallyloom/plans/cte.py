"""DuckDB common table expressions of the store data that the adapters make, for the oracle SQL."""

from __future__ import annotations

from tallyloom.schemas import CHECKOUT_STAGES, DEFAULT_RULES, FUNNEL_STEPS, MODELS

_PERCENT = "CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b} * 100, 1) END"


def pct(a: str, b: str) -> str:
    return _PERCENT.format(a=f"({a})", b=f"({b})")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST(({a}) AS DOUBLE) / ({b}) END"


def _rule(field: str, op: str, value: str | None) -> str:
    if field.startswith("has_"):
        return f"coalesce({field}, false)"
    have = f"lower(coalesce({field}, ''))"
    return f"{have} = ''" if op == "equals" else f"contains({have}, '{value}')"


def channel_case(rules=DEFAULT_RULES) -> str:
    """The default rules as CASE over utm_source, utm_medium, has_gclid, has_fbclid, referrer_host (the last rule takes the rest)."""
    whens = " ".join(f"WHEN {_rule(f, o, v)} THEN '{c}'" for _, f, o, v, c in rules)
    return f"CASE {whens} ELSE 'Other' END"


_CODES = sorted({*FUNNEL_STEPS.values(), *CHECKOUT_STAGES.values()})
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
SELECT 1 AS tenant_id, event_id AS event_uid, date_trunc('second', ts) AS occurred_at, user_id AS visitor_key,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 6 WHEN 'error' THEN 8 WHEN 'purchase' THEN 13 END AS event_type,
  k AS path_id, CASE WHEN k % 4 <> 0 THEN k END AS campaign_id, CASE WHEN k % 3 <> 0 THEN k % 5 + 1 END AS referrer_id,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN k END AS product_id, k % 10 AS geo_id, CASE WHEN user_id % 7 <> 0 THEN user_id % 7 END AS ua_id,
  CASE WHEN event_type = 'purchase' THEN event_id END AS order_ref, value, CAST(date_trunc('second', ts) + INTERVAL 330 MINUTE AS DATE) AS stat_date
FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)"""),
    "camp": ((), """
SELECT 1 AS tenant_id, c AS campaign_id,
  CASE c % 9 WHEN 0 THEN 'instagram' WHEN 1 THEN 'facebook_ads' WHEN 2 THEN 'google' WHEN 3 THEN 'newsletter' WHEN 4 THEN 'klaviyo' WHEN 5 THEN 'partner' END AS utm_source,
  CASE c % 5 WHEN 0 THEN 'cpc' WHEN 1 THEN 'email' WHEN 2 THEN 'social' END AS utm_medium,
  CASE WHEN c % 2 = 1 THEN 'camp-' || c END AS utm_campaign, c % 11 = 0 AS has_gclid, c % 13 = 0 AS has_fbclid
FROM range(1, 100) t(c)"""),
    "refs": ((), """
SELECT * FROM (VALUES (1, 1, 'www.google.com'), (1, 2, 'l.facebook.com'), (1, 3, 'shop.partner.example'), (1, 4, 'www.bing.com'), (1, 5, 'www.pinterest.com')) t(tenant_id, referrer_id, referrer_host)"""),
    "paths": ((), "SELECT 1 AS tenant_id, p AS path_id, CASE WHEN p % 2 = 0 THEN '/products/' ELSE '/pages/' END || p AS path FROM range(0, 100) t(p)"),
    "ob": (("ev",), """
SELECT *, CASE WHEN cancelled_at IS NULL THEN row_number() OVER (PARTITION BY person_id, cancelled_at IS NULL ORDER BY created_at, order_id) END AS order_sequence
FROM (SELECT 1 AS tenant_id, event_uid AS order_id, visitor_key AS person_id, visitor_key, occurred_at AS created_at, stat_date,
  CASE WHEN event_uid % 17 = 0 THEN occurred_at END AS cancelled_at, CAST(round(value * 100) AS BIGINT) AS total_minor,
  CASE WHEN event_uid % 10 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS refunded_minor,
  CASE WHEN event_uid % 10 = 0 THEN 'REFUNDED' ELSE 'PAID' END AS financial_status FROM ev WHERE event_type = 13)"""),
    "lb": (("ob",), "SELECT tenant_id, order_id, order_id % 50 AS product_id, CAST(order_id % 3 + 1 AS INT) AS quantity FROM ob"),
    "oc": ((), """
SELECT *, CASE WHEN cancelled_at IS NULL THEN row_number() OVER (PARTITION BY person_id, cancelled_at IS NULL ORDER BY created_at, order_id) END AS order_sequence
FROM (SELECT 1 AS tenant_id, o_orderkey AS order_id, o_custkey AS person_id, o_orderdate AS created_at, CAST(o_orderdate + INTERVAL 330 MINUTE AS DATE) AS stat_date,
  CASE WHEN o_orderstatus = 'F' AND starts_with(o_orderpriority, '5') THEN o_orderdate END AS cancelled_at, CAST(round(o_totalprice * 100) AS BIGINT) AS total_minor,
  0 AS refunded_minor, o_orderstatus FROM orders)"""),
    "lc": ((), """
SELECT 1 AS tenant_id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
  CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price_minor, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS discount_minor FROM lineitem"""),
    "spine": (("ob",), """
SELECT 1 AS tenant_id, CAST(d AS DATE) AS stat_date FROM generate_series(
  CAST((SELECT least(TIMESTAMP '2024-01-05 00:00:00', min(created_at)) FROM ob) + INTERVAL 330 MINUTE AS DATE), DATE '2024-01-31', INTERVAL 1 DAY) t(d)"""),
    "marked": (("ev",), """
SELECT *, CASE WHEN lag(occurred_at) OVER w IS NULL OR epoch(occurred_at) - epoch(lag(occurred_at) OVER w) > 1800 THEN 1 ELSE 0 END AS starts
FROM ev WINDOW w AS (PARTITION BY tenant_id, stat_date, visitor_key ORDER BY occurred_at, event_uid)"""),
    "marked_c": (("ev",), """
SELECT *, CASE WHEN lag(occurred_at) OVER w IS NULL OR epoch(occurred_at) - epoch(lag(occurred_at) OVER w) > 1800 THEN 1 ELSE 0 END AS starts
FROM (SELECT * REPLACE (coalesce(campaign_id, 0) AS campaign_id) FROM ev)
WINDOW w AS (PARTITION BY tenant_id, stat_date, campaign_id, visitor_key ORDER BY occurred_at, event_uid)"""),
    "vd": (("marked",), "SELECT tenant_id, stat_date, visitor_key, CAST(sum(starts) AS BIGINT) AS sessions, " + ", ".join(
        f"count(*) FILTER (event_type = {c}) AS n_{c}, min(occurred_at) FILTER (event_type = {c}) AS t_{c}" for c in _CODES
    ) + " FROM marked GROUP BY ALL"),
    "kpi": (("spine", "vd", "ob", "lb"), """
SELECT s.tenant_id, s.stat_date, coalesce(v.visitors, 0) AS visitors, coalesce(v.sessions, 0) AS sessions, coalesce(v.pageviews, 0) AS pageviews,
  coalesce(v.product_viewers, 0) AS product_viewers, coalesce(v.atc_visitors, 0) AS atc_visitors, coalesce(v.checkout_visitors, 0) AS checkout_visitors,
  coalesce(v.payment_visitors, 0) AS payment_visitors, coalesce(o.orders, 0) AS orders, coalesce(o.purchasers, 0) AS purchasers,
  coalesce(o.revenue_minor, 0) AS revenue_minor, coalesce(o.refunded_minor, 0) AS refunded_minor, coalesce(o.new_customers, 0) AS new_customers,
  greatest(0, coalesce(o.buyers, 0) - coalesce(o.new_customers, 0)) AS repeat_customers, coalesce(u.units, 0) AS units,
  CASE WHEN CAST(s.stat_date AS TIMESTAMP) > TIMESTAMP '2024-01-31 05:30:00' - INTERVAL 3 DAY THEN 1 ELSE 0 END AS is_provisional
FROM spine s LEFT JOIN (
  SELECT stat_date, count(*) AS visitors, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(n_1) AS BIGINT) AS pageviews, count(*) FILTER (n_3 > 0) AS product_viewers,
    count(*) FILTER (n_6 > 0) AS atc_visitors, count(*) FILTER (n_8 > 0) AS checkout_visitors, count(*) FILTER (n_12 > 0) AS payment_visitors FROM vd GROUP BY 1) v USING (stat_date)
LEFT JOIN (
  SELECT stat_date, count(*) AS orders, count(DISTINCT person_id) AS purchasers, CAST(sum(total_minor) AS BIGINT) AS revenue_minor, CAST(sum(refunded_minor) AS BIGINT) AS refunded_minor,
    count(DISTINCT CASE WHEN order_sequence = 1 THEN person_id END) AS new_customers, count(DISTINCT CASE WHEN order_sequence IS NOT NULL THEN person_id END) AS buyers
  FROM ob WHERE cancelled_at IS NULL GROUP BY 1) o USING (stat_date)
LEFT JOIN (SELECT stat_date, CAST(sum(quantity) AS BIGINT) AS units FROM lb JOIN ob USING (order_id) WHERE cancelled_at IS NULL GROUP BY 1) u USING (stat_date)"""),
    "funnel": (("spine", "vd"), "SELECT s.tenant_id, s.stat_date, f.step, coalesce(f.reached, 0) AS reached_visitors, coalesce(f.strict, 0) AS strict_visitors, coalesce(f.events, 0) AS events FROM spine s CROSS JOIN (SELECT unnest(range(1, 7)) AS step) x LEFT JOIN (" + " UNION ALL ".join(
        f"SELECT stat_date, {s} AS step, count(*) FILTER (n_{c} > 0) AS reached, count(*) FILTER ({' AND '.join([f't_{list(FUNNEL_STEPS.values())[0]} IS NOT NULL'] + [f't_{list(FUNNEL_STEPS.values())[k]} >= t_{list(FUNNEL_STEPS.values())[k - 1]}' for k in range(1, s)])}) AS strict, CAST(sum(n_{c}) AS BIGINT) AS events FROM vd GROUP BY 1"
        for s, c in FUNNEL_STEPS.items()
    ) + ") f ON f.stat_date = s.stat_date AND f.step = x.step"),
    "open_b": (("ob",), "SELECT tenant_id, order_id AS checkout_id, stat_date, total_minor FROM ob WHERE order_id % 5 = 0"),
    "stages": (("spine", "vd", "open_b"), "SELECT s.tenant_id, s.stat_date, CAST(x.stage AS INT) AS stage, coalesce(f.entered, 0) AS entered, coalesce(f.advanced, 0) AS advanced, coalesce(f.entered, 0) - coalesce(f.advanced, 0) AS abandoned, CASE WHEN x.stage = 3 THEN coalesce(c.value_minor, 0) ELSE 0 END AS value_minor, CASE WHEN x.stage = 3 THEN coalesce(c.records, 0) ELSE 0 END AS shopify_records FROM spine s CROSS JOIN (SELECT unnest(range(2, 8)) AS stage) x LEFT JOIN (" + " UNION ALL ".join(
        f"SELECT stat_date, {s} AS stage, count(*) FILTER (n_{c} > 0) AS entered, count(*) FILTER (n_{c} > 0" + (" AND (" + " OR ".join(f"n_{d} > 0" for k, d in CHECKOUT_STAGES.items() if k > s) + ")" if s < 7 else "") + ") AS advanced FROM vd GROUP BY 1"
        for s, c in CHECKOUT_STAGES.items()
    ) + ") f ON f.stat_date = s.stat_date AND f.stage = x.stage LEFT JOIN (SELECT stat_date, count(*) AS records, CAST(sum(total_minor) AS BIGINT) AS value_minor FROM open_b GROUP BY 1) c ON c.stat_date = s.stat_date"),
    "touch": (("ev",), "SELECT tenant_id, visitor_key, occurred_at, event_uid, campaign_id, referrer_id, path_id FROM ev WHERE campaign_id IS NOT NULL OR referrer_id IS NOT NULL"),
    "pairs": (("ob", "touch"), """
SELECT o.tenant_id, o.order_id, t.occurred_at, t.event_uid, t.campaign_id, t.referrer_id, t.path_id FROM ob o JOIN touch t
ON o.visitor_key = t.visitor_key AND t.occurred_at BETWEEN o.created_at - INTERVAL 30 DAY AND o.created_at"""),
    "pixel": (("ob", "pairs"), """
SELECT o.tenant_id, o.order_id, m.model, p.campaign_id, p.referrer_id, p.path_id AS landing_path_id, p.occurred_at AS touch_at
FROM ob o CROSS JOIN (VALUES ('pixel_first'), ('pixel_last')) m(model) LEFT JOIN (
  SELECT *, 'pixel_first' AS model FROM pairs QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY occurred_at, event_uid) = 1
  UNION ALL SELECT *, 'pixel_last' FROM pairs QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY occurred_at DESC, event_uid DESC) = 1
) p ON p.order_id = o.order_id AND p.model = m.model"""),
    "platform": (("ob",), """
SELECT tenant_id, order_id, model, CASE WHEN (order_id % 97 + 1) % 4 <> 0 THEN order_id % 97 + 1 END AS campaign_id, CASE WHEN order_id % 2 = 0 THEN order_id % 5 + 1 END AS referrer_id,
  order_id % 100 AS landing_path_id, created_at AS touch_at FROM ob CROSS JOIN (VALUES ('shopify_first'), ('shopify_last')) m(model) WHERE order_id % 3 <> 0"""),
    "attr": (("pixel", "platform", "camp", "refs"), f"""
SELECT a.*, {channel_case()} AS channel FROM (SELECT * FROM pixel UNION ALL SELECT * FROM platform) a
LEFT JOIN camp USING (campaign_id) LEFT JOIN refs USING (referrer_id)"""),
    "models": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{m}')" for m in MODELS) + ") t(model)"),
    "campaign_rows": (("marked_c", "ob", "attr", "models"), """
SELECT 1 AS tenant_id, coalesce(t.stat_date, o.stat_date) AS stat_date, coalesce(t.campaign_id, o.campaign_id) AS campaign_id, coalesce(t.model, o.model) AS model,
  coalesce(visitors, 0) AS visitors, coalesce(sessions, 0) AS sessions, coalesce(product_views, 0) AS product_views, coalesce(atc, 0) AS atc, coalesce(checkouts_started, 0) AS checkouts_started,
  coalesce(orders, 0) AS orders, coalesce(revenue_minor, 0) AS revenue_minor, coalesce(new_customers, 0) AS new_customers, greatest(0, coalesce(buyers, 0) - coalesce(new_customers, 0)) AS returning_customers
FROM (SELECT * FROM (SELECT stat_date, campaign_id, count(DISTINCT visitor_key) AS visitors, CAST(sum(starts) AS BIGINT) AS sessions, count(*) FILTER (event_type = 3) AS product_views,
  count(*) FILTER (event_type = 6) AS atc, count(*) FILTER (event_type = 8) AS checkouts_started FROM marked_c GROUP BY 1, 2) CROSS JOIN models) t
FULL JOIN (SELECT ob.stat_date, attr.model, coalesce(attr.campaign_id, 0) AS campaign_id, count(*) AS orders, CAST(sum(total_minor) AS BIGINT) AS revenue_minor,
  count(DISTINCT CASE WHEN order_sequence = 1 THEN person_id END) AS new_customers, count(DISTINCT CASE WHEN order_sequence IS NOT NULL THEN person_id END) AS buyers
  FROM ob JOIN attr USING (order_id) WHERE cancelled_at IS NULL GROUP BY 1, 2, 3) o
ON t.stat_date = o.stat_date AND t.model = o.model AND t.campaign_id = o.campaign_id"""),
    "channel_rows": (("ev", "ob", "attr", "models", "camp", "refs"), f"""
SELECT 1 AS tenant_id, coalesce(t.stat_date, o.stat_date) AS stat_date, coalesce(t.model, o.model) AS model, coalesce(t.channel, o.channel) AS channel,
  coalesce(visitors, 0) AS visitors, coalesce(orders, 0) AS orders, coalesce(revenue_minor, 0) AS revenue_minor
FROM (SELECT * FROM (SELECT stat_date, channel, CAST(sum(visitors) AS BIGINT) AS visitors FROM (
  SELECT g.stat_date, {channel_case()} AS channel, g.visitors FROM (SELECT stat_date, campaign_id, referrer_id, count(DISTINCT visitor_key) AS visitors FROM ev GROUP BY 1, 2, 3) g
  LEFT JOIN camp USING (campaign_id) LEFT JOIN refs USING (referrer_id)) GROUP BY 1, 2) CROSS JOIN models) t
FULL JOIN (SELECT ob.stat_date, attr.model, coalesce(attr.channel, 'Direct/Untracked') AS channel, count(*) AS orders, CAST(sum(total_minor) AS BIGINT) AS revenue_minor
  FROM ob JOIN attr USING (order_id) WHERE cancelled_at IS NULL GROUP BY 1, 2, 3) o
ON t.stat_date = o.stat_date AND t.model = o.model AND t.channel = o.channel"""),
    "landing_rows": (("ev", "ob", "attr"), """
SELECT 1 AS tenant_id, coalesce(t.stat_date, o.stat_date) AS stat_date, coalesce(t.path_id, o.path_id) AS path_id, coalesce(visitors, 0) AS visitors, coalesce(orders, 0) AS orders, coalesce(revenue_minor, 0) AS revenue_minor
FROM (SELECT stat_date, path_id, count(DISTINCT visitor_key) AS visitors FROM ev WHERE path_id IS NOT NULL GROUP BY 1, 2) t
FULL JOIN (SELECT ob.stat_date, landing_path_id AS path_id, count(*) AS orders, CAST(sum(total_minor) AS BIGINT) AS revenue_minor FROM ob JOIN attr USING (order_id)
  WHERE cancelled_at IS NULL AND attr.model = 'pixel_last' AND landing_path_id IS NOT NULL GROUP BY 1, 2) o ON t.stat_date = o.stat_date AND t.path_id = o.path_id"""),
    "ov": (("ob",), "SELECT tenant_id, stat_date, visitor_key, count(*) AS orders, CAST(sum(total_minor) AS BIGINT) AS revenue_minor FROM ob WHERE cancelled_at IS NULL AND visitor_key IS NOT NULL GROUP BY 1, 2, 3"),
    "geo_rows": (("ev", "ov"), """
SELECT t.tenant_id, t.stat_date, t.geo_id, t.visitors, coalesce(o.orders, 0) AS orders, coalesce(o.revenue_minor, 0) AS revenue_minor
FROM (SELECT tenant_id, stat_date, coalesce(geo_id, 0) AS geo_id, count(DISTINCT visitor_key) AS visitors FROM ev GROUP BY 1, 2, 3) t LEFT JOIN (
  SELECT l.stat_date, l.geo_id, CAST(sum(ov.orders) AS BIGINT) AS orders, CAST(sum(ov.revenue_minor) AS BIGINT) AS revenue_minor FROM ov JOIN (
    SELECT stat_date, visitor_key, coalesce(geo_id, 0) AS geo_id FROM ev QUALIFY row_number() OVER (PARTITION BY stat_date, visitor_key ORDER BY occurred_at DESC, event_uid DESC) = 1) l
  USING (stat_date, visitor_key) GROUP BY 1, 2) o USING (stat_date, geo_id)"""),
    "agents": ((), "SELECT * FROM (VALUES (1, 1, 1, 'Safari', 'iOS'), (1, 2, 1, 'Chrome', 'Android'), (1, 3, 2, 'Chrome', 'Windows'), (1, 4, 2, 'Chrome', 'Windows'), (1, 5, 3, 'Safari', 'iOS'), (1, 6, 4, NULL, NULL)) t(tenant_id, ua_id, device_type, browser, os)"),
    "device_rows": (("ev", "ov", "agents"), """
SELECT t.tenant_id, t.stat_date, coalesce(device_type, 0) AS device_type, coalesce(browser, '') AS browser, coalesce(os, '') AS os, CAST(sum(t.visitors) AS BIGINT) AS visitors,
  CAST(sum(coalesce(o.orders, 0)) AS BIGINT) AS orders, CAST(sum(coalesce(o.revenue_minor, 0)) AS BIGINT) AS revenue_minor
FROM (SELECT tenant_id, stat_date, coalesce(ua_id, 0) AS ua_id, count(DISTINCT visitor_key) AS visitors FROM ev GROUP BY 1, 2, 3) t LEFT JOIN (
  SELECT l.stat_date, l.ua_id, sum(ov.orders) AS orders, sum(ov.revenue_minor) AS revenue_minor FROM ov JOIN (
    SELECT stat_date, visitor_key, coalesce(ua_id, 0) AS ua_id FROM ev QUALIFY row_number() OVER (PARTITION BY stat_date, visitor_key ORDER BY occurred_at DESC, event_uid DESC) = 1) l
  USING (stat_date, visitor_key) GROUP BY 1, 2) o USING (stat_date, ua_id)
LEFT JOIN agents a ON a.ua_id = t.ua_id GROUP BY 1, 2, 3, 4, 5"""),
    "product_rows": (("ev", "oc", "lc"), """
SELECT tenant_id, stat_date, product_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(viewers) AS BIGINT) AS viewers, CAST(sum(atc) AS BIGINT) AS atc, CAST(sum(purchases) AS BIGINT) AS purchases,
  CAST(sum(units) AS BIGINT) AS units, CAST(sum(revenue) AS BIGINT) AS revenue_minor, CAST(sum(abandons) AS BIGINT) AS abandons FROM (
SELECT tenant_id, stat_date, product_id, count(*) FILTER (event_type = 3) AS views, count(DISTINCT CASE WHEN event_type = 3 THEN visitor_key END) AS viewers, count(*) FILTER (event_type = 6) AS atc,
  0 AS purchases, 0 AS units, 0 AS revenue, 0 AS abandons FROM ev WHERE product_id IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT oc.tenant_id, stat_date, product_id, 0, 0, 0, count(DISTINCT order_id), sum(quantity), sum(quantity * price_minor - discount_minor), 0 FROM lc JOIN oc USING (order_id) WHERE cancelled_at IS NULL GROUP BY 1, 2, 3
UNION ALL SELECT oc.tenant_id, stat_date, product_id, 0, 0, 0, 0, 0, 0, count(DISTINCT order_id) FROM lc JOIN oc USING (order_id) WHERE o_orderstatus = 'P' GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"""),
    "first_orders": (("oc",), """
SELECT tenant_id, person_id, min(created_at) AS first_at, min(CASE WHEN order_sequence = 2 THEN created_at END) AS next_at,
  min(CASE WHEN order_sequence = 1 AND (order_id % 40) % 4 <> 0 THEN order_id % 40 END) AS campaign_id
FROM oc WHERE cancelled_at IS NULL AND person_id IS NOT NULL GROUP BY 1, 2"""),
    "buckets": ((), "SELECT * FROM (VALUES (30), (60), (90), (180)) t(days_bucket)"),
    "cohorts": (("first_orders", "buckets"), """
SELECT tenant_id, CAST(date_trunc('month', first_at) AS DATE) AS cohort_month, days_bucket, count(*) AS cohort_size,
  count(*) FILTER (next_at IS NOT NULL AND next_at <= first_at + to_days(days_bucket)) AS reordered FROM first_orders CROSS JOIN buckets GROUP BY 1, 2, 3"""),
    "cohorts_c": (("first_orders", "buckets"), """
SELECT tenant_id, coalesce(campaign_id, 0) AS campaign_id, CAST(date_trunc('month', first_at) AS DATE) AS cohort_month, days_bucket, count(*) AS cohort_size,
  count(*) FILTER (next_at IS NOT NULL AND next_at <= first_at + to_days(days_bucket)) AS reordered FROM first_orders CROSS JOIN buckets GROUP BY 1, 2, 3, 4"""),
    "urls": ((), """
SELECT 1 AS tenant_id, page_id, url, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', 2) AS host,
  regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', 3) AS path,
  regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', 4) AS query FROM pages"""),
    "ident": ((), """
SELECT 1 AS tenant_id, c_custkey AS order_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((c_custkey * 7919) % 5000 AS BIGINT)) AS created_at, c_custkey % 40 AS visitor_key,
  CASE WHEN c_custkey % 5 <> 0 THEN 'c' || (c_custkey // 2) END AS customer_hash, CASE WHEN c_custkey % 7 = 0 THEN 'p' || (c_custkey // 14) END AS phone_hash,
  CASE WHEN c_custkey % 11 = 0 THEN 'e' || (c_custkey // 33) END AS email_hash FROM customer"""),
    "ikeys": (("ident",), """
SELECT tenant_id, order_id, created_at, 'customer' AS key_type, customer_hash AS key_hash FROM ident WHERE customer_hash IS NOT NULL
UNION ALL SELECT tenant_id, order_id, created_at, 'phone', phone_hash FROM ident WHERE phone_hash IS NOT NULL
UNION ALL SELECT tenant_id, order_id, created_at, 'email', email_hash FROM ident WHERE email_hash IS NOT NULL"""),
    "people": (("ident", "ikeys"), """
SELECT tenant_id, order_id, created_at, visitor_key, arg_min(peer, (peer_at, peer)) AS person_id FROM (
  WITH RECURSIVE edges AS (SELECT DISTINCT a.order_id AS x, b.order_id AS y FROM ikeys a JOIN ikeys b USING (key_type, key_hash)),
  reach(order_id, peer) AS (SELECT order_id, order_id FROM ident UNION SELECT r.order_id, e.y FROM reach r JOIN edges e ON e.x = r.peer)
  SELECT i.tenant_id, i.order_id, i.created_at, i.visitor_key, r.peer, p.created_at AS peer_at FROM ident i JOIN reach r USING (order_id) JOIN ident p ON p.order_id = r.peer)
GROUP BY 1, 2, 3, 4"""),
}


def sql(body: str, *parts: str) -> str:
    """``body`` with the CTEs it names and all they need."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in done:
            for other in _PARTS[name][0]:
                need(other)
            done[name] = _PARTS[name][1]

    for p in parts:
        need(p)
    head = ",\n".join(f"{n} AS ({text.strip()})" for n, text in done.items())
    return f"WITH {head}\n{body}" if head else body
