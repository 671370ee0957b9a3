"""Registered queries: ingest, dimensions, orders, identity, privacy, monitors, streams."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.exprs import PAGE_PREFIXES, hmac_pads
from tallyloom.functions.small import small_table
from tallyloom.operators import dims, geo, identity, ingest, monitors, orders, privacy, rollups
from tallyloom.plans import common as c
from tallyloom.plans.cte import sql
from tallyloom.plans.lineage import folder_of
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as ad
from tallyloom.sources import edits, feeds, files, sinks
from tallyloom.streaming import order_sync, person_orders, streams

NOW = datetime(2024, 1, 31)


def key63(text: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) % 9223372036854775808::UBIGINT AS BIGINT)"


def _k() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("bigint")


_E = "(SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)"


def _raw(s: SparkSession, d: str) -> DataFrame:
    return ad.table(s, d, "events").withColumn("k", _k())


# --- ingest ----------------------------------------------------------------------------------------------------------


def _batches(s, d) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    return _raw(s, d).select(
        e.alias("batch_id"), F.repeat(F.lit("x"), (k * 900).cast("int")).alias("body"), F.when(k % 5 == 0, "bad").otherwise("key-one").alias("write_key"), (e % 103).alias("n_events"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 3).cast("string")).alias("ip"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("received_at"),
        F.when(k % 4 == 1, "https://www.one.example/x?y").when(k % 4 == 2, "https://Shop.one.example.com:443").when(k % 4 == 3, "https://evil-one.example.com.test").alias("origin"),
    )


@query("ingest_gate", f"SELECT batch_id, CASE WHEN k % 5 <> 0 THEN 1 END AS tenant_id, CASE WHEN k * 900 > 65536 THEN 'too_large' WHEN n = 0 THEN 'empty' WHEN n > 100 THEN 'too_many_events' WHEN k % 5 = 0 THEN 'unknown_key' END AS reject_reason FROM (SELECT event_id AS batch_id, event_id % 103 AS n, k FROM {_E})", dates=())
def ingest_gate(s, d):
    return ingest.ingest_gate(_batches(s, d), ad.tenants(s)).select("batch_id", "tenant_id", "reject_reason")


@query("ingest_origin_check", f"SELECT event_id AS batch_id, k % 4 <> 3 AS origin_ok FROM {_E}", dates=())
def ingest_origin_check(s, d):
    return ingest.ingest_origin_check(_batches(s, d).withColumn("tenant_id", F.lit(1)), ad.tenants(s)).select("batch_id", "origin_ok")


@query("ingest_rate_limit", "SELECT event_id AS batch_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 3, date_trunc('hour', ts) ORDER BY event_id) <= 3", dates=())
def ingest_rate_limit(s, d):
    return ingest.ingest_rate_limit(_batches(s, d), most=3).select("batch_id")


@query("ingest_explode", "SELECT 1 AS tenant_id, user_id % 250 AS ip_tail, least(400, 300 + user_id) AS agent_length, event_id AS id, event_type AS n FROM events", dates=())
def ingest_explode(s, d):
    got = _raw(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("n"))).alias("e"))
    batches = got.select(
        F.lit(1).alias("tenant_id"), F.concat(F.lit("10.1.1."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        F.repeat(F.lit("a"), (F.col("user_id") + 300).cast("int")).alias("user_agent"), F.col("day").cast("timestamp").alias("received_at"), "e",
    )
    rows = ingest.ingest_explode(batches)
    return rows.select("tenant_id", F.substring_index("ip", ".", -1).cast("bigint").alias("ip_tail"), F.length("user_agent").cast("bigint").alias("agent_length"), "id", "n")


def _named(s, d) -> DataFrame:
    name = F.when(F.col("event_type") == "view", " Page_Viewed ").when(F.col("event_type") == "click", "product_viewed").when(F.col("event_type") == "signup", "input_changed").when(F.col("event_type") == "error", "checkout_started").otherwise("identify")
    return _raw(s, d).select("*", name.alias("n"), (F.col("k") % 2 + 1).cast("int").alias("s"))


_CODE = "CASE WHEN k % 2 = 0 THEN CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'error' THEN 8 END ELSE CASE event_type WHEN 'purchase' THEN 64 END END"


@query("event_map_type", f"SELECT event_id, CAST(k % 2 + 1 AS INT) AS source, CAST({_CODE} AS INT) AS event_type FROM {_E}", dates=())
def event_map_type(s, d):
    return ingest.event_map_type(_named(s, d).drop("event_type")).select("event_id", "source", "event_type")


def _lines(s, d) -> DataFrame:
    """Raw feed lines made of the event table: hostile numbers, missing ids, clocks that are wrong."""
    k, e = F.col("k"), F.col("event_id")
    text = lambda x: x.cast("string")
    return _named(s, d).select(
        "n", "s", F.when(e % 9 != 0, F.concat(F.lit("e"), text(e))).alias("id"),
        F.when(k % 10 == 0, F.lit(12)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.when(k % 8 != 0, F.concat(F.lit("u"), text(F.col("user_id")))).alias("cid"),
        F.concat(F.lit("https://shop.example/products/"), text(k), F.lit("?utm_source=s"), text(k % 3), F.lit("&utm_medium=a%20b")).alias("u"), F.when(k % 6 == 0, "https://www.google.com/").alias("r"),
        F.lit(None).cast("string").alias("cu"), F.when(k % 7 == 0, "1d").when(k % 7 == 1, "-5").otherwise(text(k)).alias("p"), F.lit("NaN").alias("v"), F.when(k % 5 == 0, "99999999999").otherwise(text(k)).alias("q"),
        F.when(k % 11 == 0, "1e30").otherwise(text(F.round(F.col("value")))).alias("a"), F.when(k % 3 == 0, "inr").when(k % 3 == 1, " Usd ").otherwise("xxx").alias("c"), text(F.when(k % 2 == 0, k)).alias("ct"), text(F.when(F.col("event_type") == "purchase", e)).alias("o"),
        F.lit(" Red Shoes ").alias("st"), F.lit(None).cast("struct<t: string, s: string, h: string>").alias("cl"), F.lit(1).alias("_t"), F.lit("10.0.0.1").alias("_ip"),
        F.lit("Mozilla/5.0 (iPhone) Safari").alias("_ua"), F.unix_millis(F.col("ts").cast("timestamp") + F.expr("INTERVAL 5 SECONDS")).alias("_rx"), F.lit(None).cast("string").alias("_corrupt"),
        F.concat(F.lit("f"), text(F.dayofmonth("ts"))).alias("_file"),
    )


def _salted(s) -> DataFrame:
    return c.store(s).withColumn("salt", F.lit("salt"))


def typed(s, d) -> DataFrame:
    return ingest.event_shred(ingest.event_map_type(_lines(s, d)), _salted(s), NOW)


_NAME = "CASE event_type WHEN 'view' THEN ' Page_Viewed ' WHEN 'click' THEN 'product_viewed' WHEN 'signup' THEN 'input_changed' WHEN 'error' THEN 'checkout_started' ELSE 'identify' END"
_MS = "CASE WHEN k % 10 = 0 THEN 12 ELSE epoch_us(ts) // 1000 END"
_CONTENT = f"[CASE WHEN k % 8 = 0 THEN '' ELSE 'u' || user_id END, {_NAME}, CAST({_MS} AS VARCHAR), 'https://shop.example/products/' || k || '?utm_source=s' || (k % 3) || '&utm_medium=a%20b', CASE k % 7 WHEN 0 THEN '1d' WHEN 1 THEN '-5' ELSE CAST(k AS VARCHAR) END]"
_ID = f"CASE WHEN event_id % 9 <> 0 THEN 'e' || event_id ELSE 'syn:' || sha256(CAST(to_json({_CONTENT}) AS VARCHAR)) END"
_UID = key63(f"'1:' || {_ID}")
_HASH = "substr(sha256('salt:u' || user_id), 1, 32)"


@query("event_shred", f"""SELECT {_UID} AS event_uid, date_trunc('second', CASE WHEN k % 10 = 0 THEN ts + INTERVAL 5 SECOND ELSE ts END) AS occurred_at, CAST({_CODE} AS INT) AS event_type,
CASE WHEN k % 8 = 0 THEN 0 ELSE {key63(f"'1:' || {_HASH}")} END AS visitor_key, {key63("'/products/' || k")} AS path_id, CASE WHEN k % 6 = 0 THEN {key63("'https://www.google.com/'")} END AS referrer_id,
{key63("concat_ws(chr(31), 's' || (k % 3), 'a b', '', '', '', '0', '0')")} AS campaign_id, CASE WHEN k % 7 NOT IN (0, 1) THEN k END AS product_id, CAST(NULL AS BIGINT) AS variant_id, CAST(CASE WHEN k % 5 = 0 THEN 65535 ELSE k END AS INT) AS qty,
CASE WHEN k % 11 = 0 THEN 4294967295 ELSE CAST(round(value) AS BIGINT) END AS amount_minor, CASE k % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' END AS currency, CASE WHEN k % 2 = 0 THEN {key63("CAST(k AS VARCHAR)")} END AS checkout_token,
CASE WHEN event_type = 'purchase' THEN event_id END AS order_ref, {key63("'red shoes'")} AS search_term_id FROM {_E} WHERE {_CODE} IS NOT NULL""", dates=())
def event_shred(s, d):
    rows = typed(s, d)
    return rows.select("event_uid", "occurred_at", "event_type", "visitor_key", "path_id", "referrer_id", "campaign_id", "product_id", "variant_id", "qty", "amount_minor", "currency", "checkout_token", "order_ref", "search_term_id")


def _replayed(s, d) -> DataFrame:
    e = ad.events(s, d).withColumn("received_at", F.col("occurred_at"))
    again = e.where("event_uid % 10 = 0").withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 MINUTE"))
    return e.unionByName(again)


@query("event_dedup", sql("SELECT tenant_id, event_uid, occurred_at AS received_at FROM ev WHERE event_uid % 7 <> 0", "ev"), dates=())
def event_dedup(s, d):
    stored = ad.events(s, d).where("event_uid % 7 = 0")
    return ingest.event_dedup(_replayed(s, d), stored).select("tenant_id", "event_uid", "received_at")


@query("import_audit", f"""SELECT file_name, count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'malformed') AS malformed, 'ok' AS status
FROM (SELECT 'f' || day(ts) AS file_name, CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN {_CODE} IS NULL THEN 'skipped' WHEN event_id % 7 = 0 THEN 'duplicate' ELSE 'accepted' END AS o FROM {_E} WHERE event_id % 9 <> 0) GROUP BY 1""", dates=())
def import_audit(s, d):
    numbered = F.substring("id", 2, 20).cast("bigint")
    raw = ingest.event_map_type(_lines(s, d).where("id is not null")).withColumn("_corrupt", F.when(numbered % 13 == 0, "{bad"))
    stored = typed(s, d).select("tenant_id", "event_uid").join(
        raw.where(numbered % 7 == 0).select(dims.key63(F.concat(F.lit("1:"), "id")).alias("event_uid")), "event_uid", "left_semi"
    )
    return ingest.import_audit(ingest.classify_lines(raw, stored))


@query("event_route", sql("SELECT CASE WHEN CAST(occurred_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' THEN 1 WHEN CAST(occurred_at AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' THEN 2 END AS shard_id, count(*) AS events FROM ev GROUP BY 1", "ev"), dates=())
def event_route(s, d):
    registry = s.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', DATE'2024-01-15'), (2, DATE'2024-01-16', DATE'2024-01-25') t(shard_id, valid_from, valid_to)")
    return ingest.event_route(ad.events(s, d), registry).groupBy("shard_id").agg(F.count("*").alias("events"))


def _addresses(s, d) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("user_id") % 4).cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(".7"))
    return _raw(s, d).select("event_id", ip.alias("ip"))


def _ranges(s) -> DataFrame:
    start = (F.lit(10) * 256 + F.col("id")) * 65536
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    return s.range(0, 3).select(
        start.cast("bigint").alias("ip_start"), (start + F.when(F.col("id") == 2, 50 * 256 + 255).otherwise(65535)).cast("bigint").alias("ip_end"), F.lit("IN").alias("country"),
        name("Region").alias("region"), name("City").alias("city"), F.col("id").cast("double").alias("lat"), F.lit(1.5).alias("lon"),
    )


_GEO = f"(SELECT event_id, CASE WHEN user_id % 4 < 2 OR (user_id % 4 = 2 AND k <= 50) THEN user_id % 4 END AS g FROM {_E})"


@query("geo_enrich", f"SELECT event_id, CASE WHEN g IS NOT NULL THEN 'IN' END AS country, 'Region' || g AS region, 'City' || g AS city, CAST(g AS DOUBLE) AS lat, CASE WHEN g IS NOT NULL THEN 1.5::DOUBLE END AS lon FROM {_GEO}", dates=())
def geo_enrich(s, d):
    return ingest.geo_enrich(_addresses(s, d), _ranges(s))


@query("geo_enrich_networks", f"""SELECT event_id, CASE WHEN f = 1 AND k // 64 = 1 THEN 'six-42' WHEN f = 1 AND u = 3 THEN 'six-128' WHEN f = 1 THEN 'six' WHEN u = 1 AND k < 64 THEN 'four-18' WHEN u = 1 THEN 'four-16' WHEN u < 3 THEN 'four' END AS country
FROM (SELECT event_id, k, user_id % 4 AS u, event_id % 3 AS f FROM {_E})""", dates=())
def geo_enrich_networks(s, d):
    """Addresses of both families, a third of IPv4 written as mapped ones; networks lie inside each other."""
    e, k, u = F.col("event_id"), F.col("k"), F.col("user_id") % 4
    quad = F.format_string("1%d.%d.%d.7", F.when(u == 3, 1).otherwise(0), u, k)
    six = F.when((u == 3) & (F.floor(k / 64) != 1), "2001:DB8::3").otherwise(F.concat(F.lit("2001:db8:"), F.lower(F.hex(k)), F.lit("::1")))
    rows = _raw(s, d).select("event_id", F.when(e % 3 == 1, six).when(e % 3 == 2, F.concat(F.lit("::ffff:"), quad)).otherwise(quad).alias("ip"))
    names = {"10.0.0.0/8": "four", "10.1.0.0/16": "four-16", "10.1.0.0/18": "four-18", "2001:db8::/32": "six", "2001:db8:40::/42": "six-42", "2001:db8::3": "six-128"}
    networks = s.createDataFrame([(n, c, None, None, None, None) for n, c in names.items()], "network STRING, country STRING, region STRING, city STRING, lat DOUBLE, lon DOUBLE")
    return geo.geo_enrich_networks(rows, networks).select("event_id", "country")


# --- dimensions ------------------------------------------------------------------------------------------------------


def _urls(s, d) -> DataFrame:
    return ad.table(s, d, "pages").select(F.lit(1).alias("tenant_id"), "url")


_PATH = "left(CASE WHEN path = '' THEN '/' ELSE path END, 512)"
_TYPES = "CASE WHEN p IN ('/', '') THEN 'home' " + " ".join(f"WHEN starts_with(p, '{a}') THEN '{b}'" for a, b in PAGE_PREFIXES) + " ELSE 'other' END"
query("dim_path", sql(f"SELECT 1 AS tenant_id, {key63('p')} AS path_id, p AS path, {_TYPES} AS page_type FROM (SELECT DISTINCT {_PATH} AS p FROM urls WHERE length(url) > 0)", "urls"), dates=())(lambda s, d: dims.dim_path(_urls(s, d)))
query("dim_referrer", sql(f"SELECT 1 AS tenant_id, {key63('u')} AS referrer_id, h AS referrer_host, u AS referrer_url FROM (SELECT DISTINCT left(url, 512) AS u, lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')) AS h FROM urls WHERE length(url) > 0)", "urls"), dates=())(lambda s, d: dims.dim_referrer(_urls(s, d), "url"))


def _tagged(s, d) -> DataFrame:
    """Page URLs with more parameters, by their number: encoded, repeated and blank ones."""
    p = F.col("page_id")
    more = F.when(p % 4 == 0, "&utm_medium=a%2Bb+c&utm_medium=paid").when(p % 4 == 1, "&gclid=abc").when(p % 4 == 2, "&utm_term=").otherwise("")
    glue = F.when(F.col("url").contains("?"), "").otherwise("?x=1")
    return ad.table(s, d, "pages").select(F.lit(1).alias("tenant_id"), F.concat(F.regexp_replace("url", "#.*$", ""), glue, more).alias("url"))


_Q = "SELECT page_id, CASE WHEN query <> '' THEN '&' || query ELSE '&x=1' END || CASE page_id % 4 WHEN 0 THEN '&utm_medium=paid' WHEN 1 THEN '&gclid=abc' ELSE '' END || '&' AS q FROM urls"
_VALUE = "nullif(regexp_extract(q, '.*&utm_{k}=([^&]*)&', 1), '')"
_TUPLE = "concat_ws(chr(31), coalesce(utm_source, ''), coalesce(utm_medium, ''), coalesce(utm_campaign, ''), coalesce(utm_content, ''), coalesce(utm_term, ''), CAST(CAST(has_gclid AS INT) AS VARCHAR), CAST(CAST(has_fbclid AS INT) AS VARCHAR))"
query("dim_campaign", sql(f"SELECT 1 AS tenant_id, {key63(_TUPLE)} AS campaign_id, * FROM (SELECT DISTINCT " + ", ".join(f"{_VALUE.format(k=k)} AS utm_{k}" for k in dims.UTM) + f", contains(q, '&gclid=') AS has_gclid, contains(q, '&fbclid=') AS has_fbclid FROM ({_Q})) WHERE coalesce(utm_source, utm_medium, utm_campaign, utm_content, utm_term) IS NOT NULL OR has_gclid OR has_fbclid", "urls"), dates=())(lambda s, d: dims.dim_campaign(_tagged(s, d)))

_AGENTS = ("Mozilla/5.0 (Windows NT 10.0) Chrome/120 Edg/120", "Mozilla/5.0 (Linux; Android 13) SamsungBrowser/20 Mobile", "Googlebot/2.1", "Mozilla/5.0 (iPad; CPU OS 16) Safari/604", "Mozilla/5.0 (X11; Linux) Firefox/120")
_AGENT_ROWS = ((2, "Edge", "Windows"), (1, "Samsung Internet", "Android"), (4, None, None), (3, "Safari", "iOS"), (2, "Firefox", "Linux"))
_CASE = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AGENTS)) + " END"
_QUOTED = lambda x: "NULL" if x is None else repr(x)
query("dim_useragent", f"SELECT 1 AS tenant_id, {key63('user_agent')} AS ua_id, user_agent, device_type, browser, os FROM (SELECT DISTINCT user_id % 5 AS i, {_CASE} AS user_agent FROM events) JOIN (VALUES " + ", ".join(f"({i}, {t}, {_QUOTED(b)}, {_QUOTED(o)})" for i, (t, b, o) in enumerate(_AGENT_ROWS)) + ") v(i, device_type, browser, os) USING (i)", dates=())(
    lambda s, d: dims.dim_useragent(_raw(s, d).select(F.lit(1).alias("tenant_id"), F.get(F.lit(list(_AGENTS)), (F.col("user_id") % 5).cast("int")).alias("user_agent")))
)


@query("dim_visitor", sql(f"SELECT tenant_id, visitor_hash, min(occurred_at) AS first_seen_at, max(occurred_at) AS last_seen_at, {key63("'1:' || visitor_hash")} AS visitor_key FROM (SELECT tenant_id, occurred_at, substr(sha256('salt:u' || visitor_key), 1, 32) AS visitor_hash FROM ev) GROUP BY 1, 2", "ev"), dates=())
def dim_visitor(s, d):
    named = ad.events(s, d).withColumns({"client_id": F.concat(F.lit("u"), F.col("visitor_key").cast("string")), "salt": F.lit("salt")})
    return dims.dim_visitor(named)


@query("dim_geo", f"SELECT {key63("concat_ws(chr(31), 'in', 'region' || g, 'city' || g)")} AS geo_id, 'IN' AS country, 'Region' || g AS region, 'City' || g AS city, CAST(g AS DOUBLE) AS lat, 1.5::DOUBLE AS lon FROM (SELECT DISTINCT g FROM {_GEO} WHERE g IS NOT NULL)", dates=())
def dim_geo(s, d):
    return dims.dim_geo(geo_enrich(s, d))


@query("dim_intern", sql(f"SELECT DISTINCT path_id, geo_id, {key63("concat_ws(chr(31), CAST(path_id AS VARCHAR), CAST(geo_id AS VARCHAR))")} AS pair_id FROM ev WHERE path_id % 3 <> 0", "ev"), dates=())
def dim_intern(s, d):
    e = ad.events(s, d)
    return dims.dim_intern(e, ["path_id", "geo_id"], "pair_id", dims.dim_intern(e.where("path_id % 3 = 0"), ["path_id", "geo_id"], "pair_id"))


@query("dim_search_term", sql(f"SELECT tenant_id, {key63('lower(t)')} AS search_term_id, arg_min(t, (occurred_at, event_uid)) AS term FROM (SELECT *, CASE WHEN event_uid % 2 = 0 THEN 'Red Shoe ' ELSE 'red shoe ' END || (path_id % 20) AS t FROM ev) GROUP BY 1, 2", "ev"), dates=())
def dim_search_term(s, d):
    term = F.concat(F.when(F.col("event_uid") % 2 == 0, " Red Shoe ").otherwise(" red shoe "), (F.col("path_id") % 20).cast("string"), F.lit(" "))
    return dims.dim_search_term(ad.events(s, d).withColumn("term", term))


@query("dim_click_target", sql(f"SELECT DISTINCT tenant_id, label, selector, href, {key63("concat_ws(chr(31), coalesce(label, ''), coalesce(selector, ''), coalesce(href, ''))")} AS click_target_id FROM (SELECT 1 AS tenant_id, CASE WHEN path_id % 2 = 0 THEN 'b' || path_id END AS label, CASE WHEN path_id % 3 = 0 THEN '#s' END AS selector, CASE WHEN path_id % 5 = 0 THEN '/h' END AS href FROM ev) WHERE coalesce(label, selector, href) IS NOT NULL", "ev"), dates=())
def dim_click_target(s, d):
    p = F.col("path_id")
    rows = ad.events(s, d).select("tenant_id", F.when(p % 2 == 0, F.concat(F.lit("b"), p.cast("string"))).alias("label"), F.when(p % 3 == 0, "#s").alias("selector"), F.when(p % 5 == 0, "/h").alias("href"))
    return dims.dim_click_target(rows)


# --- orders ----------------------------------------------------------------------------------------------------------


def raw_orders(s, d) -> DataFrame:
    """The order and line tables as the platform's nested documents."""
    o, text = F.col("o_orderkey"), lambda x: x.cast("string")
    gid = lambda kind, x: F.concat(F.lit(f"gid://shop/{kind}/"), text(x))
    money = lambda x: F.struct(F.struct(text(x).alias("amount")).alias("shopMoney"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    node = lambda x: F.struct(
        gid("LineItem", o * 1000 + x["l_partkey"] % 1000).alias("id"), F.lit("Title").alias("title"), F.lit(None).cast("string").alias("sku"), x["quantity"].alias("quantity"),
        F.struct(gid("Product", x["l_partkey"]).alias("id")).alias("product"), F.struct(F.lit(None).cast("string").alias("id")).alias("variant"),
        money(x["price"]).alias("originalUnitPriceSet"), F.struct(F.struct(F.lit(None).cast("string").alias("amount")).alias("shopMoney")).alias("totalDiscountSet"),
    )
    # lines are dealt out and collected bare, and only written out in the documents: shuffled whole, each is several times as large
    bare = ad.table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("int")).alias("quantity"), F.round("l_extendedprice", 2).alias("price"))
    lines = bare.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "quantity", "price")).alias("_lines"))
    utm = F.struct(F.when(o % 3 == 0, "google").alias("source"), F.when(o % 3 == 0, "cpc").alias("medium"), *(F.lit(None).cast("string").alias(k) for k in ("campaign", "content", "term")))
    visit = F.struct(F.concat(F.lit("https://shop.example/pages/"), text(o % 10)).alias("landingPage"), F.lit(None).cast("string").alias("referrerUrl"), iso(F.col("o_orderdate")).alias("occurredAt"), utm.alias("utmParameters"))
    base = ad.table(s, d, "orders").join(lines, o == F.col("l_orderkey"), "left")
    return base.select(
        F.lit(1).alias("tenant_id"), gid("Order", o).alias("id"), F.when(o % 50 != 0, iso(F.col("o_orderdate"))).otherwise("not a date").alias("createdAt"), iso(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updatedAt"),
        F.when(F.col("o_orderstatus") == "F", iso(F.col("o_orderdate"))).alias("cancelledAt"), F.lit("PAID").alias("displayFinancialStatus"), F.lit("INR").alias("currencyCode"), F.struct(gid("Customer", F.col("o_custkey")).alias("id")).alias("customer"),
        F.concat(F.lit(" User"), text(F.col("o_custkey")), F.lit("@Example.com ")).alias("email"), F.concat(F.lit("+91 98765 "), F.lpad(text(F.col("o_custkey") % 100000), 5, "0")).alias("phone"), F.lit("web").alias("sourceName"),
        F.lit("/").alias("landingSite"), F.lit("").alias("referringSite"), F.array(F.lit("A"), F.lit("B")).alias("discountCodes"), *(money(F.round("o_totalprice", 2)).alias(n) for n in ("subtotalPriceSet", "totalPriceSet")),
        money(F.lit("x")).alias("totalDiscountsSet"), money(F.lit(None).cast("string")).alias("totalRefundedSet"), F.struct(F.transform(F.coalesce("_lines", F.array().cast(lines.schema["_lines"].dataType)), node).alias("nodes")).alias("lineItems"),
        F.struct(F.lit(True).alias("ready"), (o % 9).cast("int").alias("daysToConversion"), F.struct((o % 4).cast("int").alias("count")).alias("momentsCount"), visit.alias("firstVisit"), F.when(o % 2 == 0, visit).alias("lastVisit")).alias("customerJourneySummary"),
    )


def flat(s, d) -> DataFrame:
    return orders.orders_flatten(raw_orders(s, d))


_MINOR = "CAST(round(CAST(CAST(round(o_totalprice, 2) AS VARCHAR) AS DOUBLE) * 100) AS BIGINT)"


@query("orders_flatten", f"SELECT o_orderkey AS order_id, o_custkey AS shopify_customer_id, CASE WHEN o_orderkey % 50 <> 0 THEN date_trunc('second', o_orderdate) END AS created_at, CASE WHEN o_orderstatus = 'F' THEN date_trunc('second', o_orderdate) END AS cancelled_at, 'A,B' AS discount_codes, {_MINOR} AS total_minor, CAST(0 AS BIGINT) AS discount_minor, CAST(o_orderkey % 9 AS INT) AS days_to_conversion FROM orders", dates=())
def orders_flatten(s, d):
    return flat(s, d).select("order_id", "shopify_customer_id", "created_at", "cancelled_at", "discount_codes", "total_minor", "discount_minor", "days_to_conversion")


def _versions(s, d) -> DataFrame:
    base = ad.star_orders(s, d).select("tenant_id", "order_id", "created_at", F.col("created_at").alias("updated_at"), F.lit("INR").alias("currency"), "total_minor", F.concat(F.lit("h"), F.col("person_id").cast("string")).alias("email_hash"))
    later = F.col("updated_at") + F.expr("INTERVAL 2 DAYS")
    edited = base.where("order_id % 3 = 0").withColumns({"updated_at": later, "currency": F.lit("USD"), "total_minor": F.col("total_minor") + 1, "email_hash": F.when(F.col("order_id") % 2 == 0, F.lit("new"))})
    return base.unionByName(edited)


@query("orders_merge", sql("SELECT tenant_id, order_id, created_at, CASE WHEN order_id % 3 = 0 THEN created_at + INTERVAL 2 DAY ELSE created_at END AS updated_at, 'INR' AS currency, CASE WHEN order_id % 3 = 0 THEN total_minor + 1 ELSE total_minor END AS total_minor, CASE WHEN order_id % 6 = 0 THEN 'new' ELSE 'h' || person_id END AS email_hash FROM oc", "oc"), dates=())
def orders_merge(s, d):
    return orders.orders_merge(_versions(s, d))


@query("orders_incremental", sql("SELECT order_id, created_at AS updated_at, (SELECT max(created_at) FROM oc) AS watermark FROM oc WHERE created_at >= TIMESTAMP '2000-12-31 23:55:00'", "oc"), dates=())
def orders_incremental(s, d):
    rows = ad.star_orders(s, d).select("order_id", F.col("created_at").alias("updated_at"))
    fresh, mark = orders.orders_incremental(rows, "2001-01-01 00:00:00")
    return fresh.join(F.broadcast(mark))  # one row


@query("orders_sync", sql("SELECT order_id, total_minor FROM oc", "oc"), dates=())
def orders_sync(s, d):
    """Three tenants pulled page by page into the stored orders, in runs that stop after two pages each."""
    folder = folder_of(s)
    source = ad.star_orders(s, d).select((F.col("order_id") % 3).cast("int").alias("tenant_id"), "order_id", F.col("created_at").alias("updated_at"), "created_at", "total_minor")
    page = max(1, source.count() // 10)
    for run in range(4):
        order_sync.sync_orders(s, source, f"{folder}/cursors", lambda rows, name: streams.merge_into_orders(s, rows, f"{folder}/orders", name), f"run{run}", page=page, pages=2)
    return streams.read_orders(s, f"{folder}/orders", source).select("order_id", "total_minor")


@query("orders_quarantine", "SELECT o_orderkey AS order_id, 'bad created_at' AS reason FROM orders WHERE o_orderkey % 50 = 0", dates=())
def orders_quarantine(s, d):
    return orders.orders_quarantine(flat(s, d))[1].select("order_id", "reason")


@query("line_items_explode", "SELECT l_orderkey * 1000 + l_partkey % 1000 AS line_id, any_value(l_orderkey) AS order_id FROM lineitem GROUP BY 1", dates=())
def line_items_explode(s, d):
    return orders.line_items_explode(flat(s, d)).select("line_id", "order_id")


@query("platform_attribution", f"""SELECT o_orderkey AS order_id, model, CASE WHEN o_orderkey % 3 = 0 THEN {key63("concat_ws(chr(31), 'google', 'cpc', '', '', '', '0', '0')")} END AS campaign_id, {key63("'/pages/' || (o_orderkey % 10)")} AS landing_path_id, date_trunc('second', o_orderdate) AS touch_at
FROM orders CROSS JOIN (VALUES ('shopify_first'), ('shopify_last')) m(model) WHERE model = 'shopify_first' OR o_orderkey % 2 = 0""", dates=())
def platform_attribution(s, d):
    return orders.platform_attribution(flat(s, d)).select("order_id", "model", "campaign_id", "landing_path_id", "touch_at")


_PADS = [p.hex() for p in hmac_pads(b"tenant-salt")]


def _hmac(text: str) -> str:
    return f"substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({text})))), 1, 32)"


@query("orders_hash_contacts", f"""SELECT 1 AS tenant_id, o_orderkey AS order_id, {_hmac("'user' || o_custkey || '@example.com'")} AS email_hash, {_hmac("'98765' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0')")} AS phone_hash, {_hmac("CAST(o_custkey AS VARCHAR)")} AS customer_hash FROM orders""", dates=())
def orders_hash_contacts(s, d):
    pads = small_table(s, [(1, *map(bytearray, hmac_pads(b"tenant-salt")))], "tenant_id INT, inner_pad BINARY, outer_pad BINARY")
    return orders.orders_hash_contacts(flat(s, d), pads).select("tenant_id", "order_id", "email_hash", "phone_hash", "customer_hash")


@query("quarantine_report", "SELECT 1 AS tenant_id, count(*) AS rejected, string_agg(CASE WHEN n <= 5 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY n) AS first_orders FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderkey % 50 = 0) HAVING count(*) > 0", dates=())
def quarantine_report(s, d):
    report = orders.quarantine_report(orders.orders_quarantine(flat(s, d))[1])
    return report.select("tenant_id", "rejected", F.array_join(F.transform("examples", lambda x: x["order_id"].cast("string")), ",").alias("first_orders"))


@query("order_visitor_link", sql("SELECT tenant_id, order_id, CASE WHEN order_id % 4 = 0 THEN visitor_key END AS own, visitor_key FROM ob", "ob"), dates=())
def order_visitor_link(s, d):
    unlinked = ad.event_orders(s, d).withColumn("own", F.when(F.col("order_id") % 4 == 0, F.col("visitor_key"))).withColumn("visitor_key", F.col("own"))
    return orders.order_visitor_link(unlinked, ad.events(s, d)).select("tenant_id", "order_id", "own", "visitor_key")


# --- identity --------------------------------------------------------------------------------------------------------

query("identity_keys", sql("SELECT tenant_id, order_id, created_at, key_type, key_hash FROM ikeys", "ikeys"), dates=())(lambda s, d: identity.identity_keys(ad.identity_orders(s, d)))
query("identity_resolve", sql("SELECT tenant_id, order_id, person_id FROM people", "people"), dates=())(lambda s, d: identity.identity_resolve(ad.identity_orders(s, d)))
query("identity_keyless", sql("SELECT tenant_id, order_id, order_id AS person_id FROM ident WHERE coalesce(customer_hash, phone_hash, email_hash) IS NULL", "ident"), dates=())(lambda s, d: identity.identity_keyless(ad.identity_orders(s, d)))


def _stored(s, d) -> tuple[DataFrame, DataFrame]:
    """(keys of the even orders with their persons, the odd orders)."""
    everything = ad.identity_orders(s, d)
    old = everything.where("order_id % 2 = 0")
    keys = identity.identity_keys(old).join(identity.identity_resolve(old), ["tenant_id", "order_id"])
    return keys.select("tenant_id", "key_type", "key_hash", "person_id").distinct(), everything.where("order_id % 2 = 1")


_STEPS = """
WITH RECURSIVE old_keys AS (SELECT key_type, key_hash, order_id, created_at FROM ikeys WHERE order_id % 2 = 0), new_keys AS (SELECT key_type, key_hash, order_id FROM ikeys WHERE order_id % 2 = 1),
oe AS (SELECT DISTINCT a.order_id AS x, b.order_id AS y FROM old_keys a JOIN old_keys b USING (key_type, key_hash)),
orch(x, y) AS (SELECT DISTINCT order_id, order_id FROM old_keys UNION SELECT r.x, e.y FROM orch r JOIN oe e ON e.x = r.y),
op AS (SELECT r.x AS order_id, arg_min(r.y, (i.created_at, r.y)) AS person_id FROM orch r JOIN ident i ON i.order_id = r.y GROUP BY 1),
stored AS (SELECT DISTINCT key_type, key_hash, person_id FROM old_keys JOIN op USING (order_id)),
hit AS (SELECT 'order' AS k, n.order_id AS i, 'person' AS k2, s.person_id AS i2 FROM new_keys n JOIN stored s USING (key_type, key_hash)),
ne AS (SELECT DISTINCT k AS k, i AS i, k2, i2 FROM hit UNION SELECT DISTINCT k2, i2, k, i FROM hit UNION SELECT DISTINCT 'order', a.order_id, 'order', b.order_id FROM new_keys a JOIN new_keys b USING (key_type, key_hash)),
nr(k, i, k2, i2) AS (SELECT DISTINCT k, i, k, i FROM ne UNION SELECT r.k, r.i, e.k2, e.i2 FROM nr r JOIN ne e ON e.k = r.k2 AND e.i = r.i2),
placed AS (SELECT k AS node_kind, i AS node_id, arg_min(i2, (CASE WHEN k2 = 'person' THEN 0 ELSE 1 END, i2)) AS person_id FROM nr GROUP BY 1, 2),
alone AS (SELECT 'order' AS node_kind, order_id AS node_id, order_id AS person_id FROM ident WHERE order_id % 2 = 1 AND coalesce(customer_hash, phone_hash, email_hash) IS NULL)
"""


@query("identity_incremental", sql(f"SELECT 1 AS tenant_id, * FROM ({_STEPS} SELECT * FROM placed UNION ALL SELECT * FROM alone)", "ikeys", "ident"), dates=())
def identity_incremental(s, d):
    return identity.identity_incremental(*_stored(s, d))


@query("identity_merges", sql(f"""SELECT 1 AS tenant_id, * FROM ({_STEPS} SELECT p.person_id AS survivor_id, p.node_id AS absorbed_id, arg_min(s.key_type, CASE s.key_type WHEN 'customer' THEN 1 WHEN 'phone' THEN 2 ELSE 3 END) AS key_type
FROM placed p JOIN stored s ON s.person_id = p.node_id JOIN (SELECT DISTINCT key_type, key_hash FROM new_keys) n USING (key_type, key_hash) WHERE p.node_kind = 'person' AND p.node_id <> p.person_id GROUP BY 1, 2)""", "ikeys", "ident"), dates=())
def identity_merges(s, d):
    stored, fresh = _stored(s, d)
    return identity.identity_merges(stored, identity.identity_incremental(stored, fresh), fresh)


@query("visitor_person_link", sql("SELECT tenant_id, visitor_key, CASE WHEN visitor_key % 10 = 0 THEN -1 ELSE arg_min(person_id, (created_at, order_id)) END AS person_id FROM people GROUP BY 1, 2", "people"), dates=())
def visitor_person_link(s, d):
    placed = ad.identity_orders(s, d)
    owned = placed.select("tenant_id", "order_id", "created_at", "visitor_key").join(identity.identity_resolve(placed), ["tenant_id", "order_id"])
    seen = placed.select("tenant_id", "visitor_key").distinct().withColumn("person_id", F.when(F.col("visitor_key") % 10 == 0, F.lit(-1).cast("bigint")))
    return identity.visitor_person_link(seen, owned)


# --- privacy ---------------------------------------------------------------------------------------------------------


def _split(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("tenant_id", (F.col(key) % 2 + 1).cast("int"))


query("purge_due", "SELECT tenant_id, CASE WHEN tenant_id = 2 THEN 'two.example.com' END AS shop_domain, n AS events FROM (SELECT CAST(event_id % 2 + 1 AS INT) AS tenant_id, count(*) AS n FROM events GROUP BY 1) WHERE tenant_id = 2", dates=())(
    lambda s, d: privacy.purge_due(ad.tenants(s), NOW).join(_split(ad.events(s, d), "event_uid").groupBy("tenant_id").agg(F.count("*").alias("events")), "tenant_id").select("tenant_id", "shop_domain", "events")
)


_PURGED = {
    "events": ("ev", "event_uid"), "orders": ("oc", "order_id"), "order_line_items": ("lc", "order_id"), "identity_keys": ("ikeys", "order_id"),
    "persons": ("(SELECT DISTINCT person_id FROM oc)", "person_id"), "dim_visitor": ("(SELECT DISTINCT visitor_key FROM ev)", "visitor_key"),
    "dim_campaign": ("camp", "campaign_id"), "dim_path": ("paths", "path_id"),
}
_PURGE = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) FILTER ({k} % 2 = 1) AS rows_removed, count(*) FILTER ({k} % 2 = 0) AS rows_left FROM {t}" for n, (t, k) in _PURGED.items())


@query("purge_store", sql(_PURGE + " UNION ALL SELECT 'rollup', 0, count(*) FROM ov", "ev", "oc", "lc", "ikeys", "camp", "paths", "ov"), dates=())
def purge_store(s, d):
    events, placed = ad.events(s, d), ad.star_orders(s, d)
    source = {
        "events": events, "orders": placed, "order_line_items": ad.star_lines(s, d), "identity_keys": identity.identity_keys(ad.identity_orders(s, d)),
        "persons": placed.select("person_id").distinct(), "dim_visitor": events.select("visitor_key").distinct(), "dim_campaign": ad.dim_campaign(s), "dim_path": ad.dim_path(s),
    }
    tables = {n: _split(df, _PURGED[n][1]) for n, df in source.items()} | {"rollup": rollups.orders_by_visitor(c.ob(s, d))}
    kept, counts = privacy.purge_store(tables, privacy.purge_due(ad.tenants(s), NOW), rollups=("rollup",))
    left = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("table_name"), "rows_left") for n, df in kept.items()])
    return left.join(counts.drop("tenant_id"), "table_name", "left").select("table_name", F.coalesce("rows_removed", F.lit(0)).alias("rows_removed"), "rows_left")


@query("purge_tombstone", "SELECT CAST(user_id AS INT) AS tenant_id, CASE WHEN user_id % 3 = 0 THEN 'uninstalled' ELSE 'active' END AS status, CASE WHEN user_id % 3 <> 0 THEN 'd' || user_id END AS custom_domain, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS purged_at FROM (SELECT DISTINCT user_id FROM events)", dates=())
def purge_tombstone(s, d):
    gone = F.col("tenant_id") % 3 == 0
    at = F.lit("2024-01-01").cast("timestamp")
    stores = ad.events(s, d).select(F.col("visitor_key").cast("int").alias("tenant_id")).distinct().select(
        "tenant_id", F.when(gone, "uninstalled").otherwise("active").alias("status"), F.concat(F.lit("d"), F.col("tenant_id").cast("string")).alias("custom_domain"),
        F.when(gone, at).alias("purge_after"), F.lit(None).cast("timestamp").alias("purged_at"),
    )
    return privacy.purge_tombstone(stores, privacy.purge_due(stores, NOW), NOW).select("tenant_id", "status", "custom_domain", "purged_at")


def _redacted(s, d) -> dict[str, DataFrame]:
    """All tables that know persons, after every seventh customer, by hash of each type and some by number, has asked to be forgotten."""
    base = ad.identity_orders(s, d)
    placed = base.join(identity.identity_resolve(base), ["tenant_id", "order_id"]).withColumn("shopify_customer_id", F.col("order_id") * 10)
    keys = identity.identity_keys(placed).join(placed.select("tenant_id", "order_id", "person_id"), ["tenant_id", "order_id"])
    keys = keys.select("tenant_id", "key_type", "key_hash", "person_id").distinct()
    asked = identity.identity_keys(base).where(_ASKED).select("tenant_id", "key_type", "key_hash", F.when(F.col("order_id") % 2 == 0, F.col("order_id") * 10).alias("shopify_customer_id"))
    merges = placed.where("person_id <> order_id").select("tenant_id", F.col("person_id").alias("survivor_id"), F.col("order_id").alias("absorbed_id"))
    tables = {
        "orders": placed, "abandoned_checkouts": placed.select("tenant_id", F.col("order_id").alias("checkout_id"), "person_id", "email_hash", "phone_hash"),
        "visitors": placed.select("tenant_id", F.col("order_id").alias("visitor_key"), "person_id"), "customers": placed.select("tenant_id", "shopify_customer_id", "person_id"),
        "identity_keys": keys, "persons": placed.select("tenant_id", "person_id").distinct(), "person_merges": merges, "resequence_queue": placed.select("tenant_id", "person_id").distinct(),
    }
    return privacy.redact_person(tables, asked)


_ASKED = "(key_type = 'phone' AND order_id % 3 = 0) OR (key_type = 'email' AND order_id % 5 = 0) OR (key_type = 'customer' AND order_id % 49 = 3)"
_FORGET = f"""asked AS (SELECT key_hash, CASE WHEN order_id % 2 = 0 THEN order_id * 10 END AS cust FROM ikeys WHERE {_ASKED}), hashes AS (SELECT DISTINCT key_hash FROM asked), custs AS (SELECT DISTINCT cust FROM asked WHERE cust IS NOT NULL),
gone AS (SELECT DISTINCT person_id FROM people JOIN ikeys USING (order_id) JOIN hashes USING (key_hash)),
base AS (SELECT p.order_id, p.person_id, p.person_id IN (SELECT person_id FROM gone) AS lost, coalesce(i.email_hash IN (SELECT key_hash FROM hashes) OR i.phone_hash IN (SELECT key_hash FROM hashes) OR i.customer_hash IN (SELECT key_hash FROM hashes), false) AS known,
  coalesce(i.email_hash IN (SELECT key_hash FROM hashes), false) OR coalesce(i.phone_hash IN (SELECT key_hash FROM hashes), false) AS contact, coalesce(i.email_hash IN (SELECT key_hash FROM hashes), false) OR coalesce(i.phone_hash IN (SELECT key_hash FROM hashes), false) OR coalesce(i.customer_hash IN (SELECT key_hash FROM hashes), false) AS any_hash,
  p.order_id * 10 IN (SELECT cust FROM custs) AS asked, i.customer_hash, i.phone_hash, i.email_hash FROM people p JOIN ident i USING (order_id))"""


def _forgotten(body: str) -> str:
    head = sql("", "people", "ident", "ikeys").rstrip()
    return f"{head}, {_FORGET} {body}"


@query("redact_person", _forgotten("SELECT order_id, " + ", ".join(f"CASE WHEN NOT (lost OR any_hash OR asked) THEN {c} END AS {c}" for c in ("person_id", "customer_hash", "phone_hash", "email_hash")) + ", CASE WHEN NOT (lost OR any_hash OR asked) THEN order_id * 10 END AS shopify_customer_id FROM base"), dates=())
def redact_person(s, d):
    return _redacted(s, d)["orders"].select("order_id", "person_id", "customer_hash", "phone_hash", "email_hash", "shopify_customer_id")


_LEFT = {
    "abandoned_checkouts": "SELECT count(*) AS n, sum(CASE WHEN NOT (lost OR contact) THEN person_id END) AS p FROM base",
    "visitors": "SELECT count(*), sum(CASE WHEN NOT lost THEN person_id END) FROM base",
    "customers": "SELECT count(*) FILTER (NOT asked), sum(CASE WHEN NOT asked AND NOT lost THEN person_id END) FROM base",
    "identity_keys": "SELECT count(*), sum(person_id) FROM (SELECT DISTINCT key_type, key_hash, person_id FROM people JOIN ikeys USING (order_id)) WHERE person_id NOT IN (SELECT person_id FROM gone) AND key_hash NOT IN (SELECT key_hash FROM hashes)",
    "persons": "SELECT count(*), sum(person_id) FROM (SELECT DISTINCT person_id FROM people) WHERE person_id NOT IN (SELECT person_id FROM gone)",
    "person_merges": "SELECT count(*), sum(person_id) FROM people WHERE person_id <> order_id AND person_id NOT IN (SELECT person_id FROM gone) AND order_id NOT IN (SELECT person_id FROM gone)",
    "resequence_queue": "SELECT count(*), sum(person_id) FROM (SELECT DISTINCT person_id FROM people) WHERE person_id NOT IN (SELECT person_id FROM gone)",
}


@query("redact_tables", _forgotten(" UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(n AS BIGINT) AS rows_left, CAST(coalesce(p, 0) AS BIGINT) AS person_sum FROM ({q}) t(n, p)" for n, q in _LEFT.items())), dates=())
def redact_tables(s, d):
    """Rows that each further table keeps, and the sum of the persons they still name."""
    left = _redacted(s, d)
    named = {n: F.col("survivor_id" if n == "person_merges" else "person_id") for n in _LEFT}
    sums = [left[n].agg(F.count("*").alias("rows_left"), F.coalesce(F.sum(named[n]), F.lit(0)).cast("bigint").alias("person_sum")).select(F.lit(n).alias("table_name"), "rows_left", "person_sum") for n in _LEFT]
    return reduce(DataFrame.unionByName, sums)


@query("purge_files", sql("SELECT CAST(event_uid % 5 AS INT) AS tenant_id, count(*) AS rows_left, CAST(0 AS BIGINT) AS rows_removed FROM ev WHERE event_uid % 5 NOT IN (1, 3) GROUP BY 1 UNION ALL SELECT CAST(event_uid % 5 AS INT), 0, count(*) FROM ev WHERE event_uid % 5 IN (1, 3) GROUP BY 1", "ev"), dates=())
def purge_files(s, d):
    """Two of five tenants leave a stored table by their folders."""
    folder, tenant = folder_of(s), (F.col("event_uid") % 5).cast("int")
    sinks.sink_events(ad.events(s, d).withColumn("tenant_id", tenant), f"{folder}/events")
    due = ad.events(s, d).select(tenant.alias("tenant_id")).where("tenant_id in (1, 3)").distinct()
    gone = edits.purge_tenants(s, f"{folder}/events", due, "purge")
    left = files.read_table(s, f"{folder}/events", ad.events(s, d)).groupBy("tenant_id").agg(F.count("*").alias("rows_left"))
    return left.join(gone, "tenant_id", "full").select(F.col("tenant_id").cast("int").alias("tenant_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_left", "rows_removed")))


@query("redact_files", sql("SELECT event_uid, CASE WHEN visitor_key % 10 <> 0 THEN visitor_key END AS visitor_key FROM ev WHERE event_uid % 97 <> 0", "ev"), dates=())
def redact_files(s, d):
    """Events deleted by key and visitors cleared, file by file, in a stored table."""
    folder, events = folder_of(s), ad.events(s, d)
    sinks.sink_events(events, f"{folder}/events")
    edits.delete_hits(s, f"{folder}/events", events.where("event_uid % 97 = 0"), ["tenant_id", "event_uid"], "delete")
    edits.clear_hits(s, f"{folder}/events", events.where("visitor_key % 10 = 0"), ["tenant_id", "visitor_key"], ("visitor_key",), "clear")
    return files.read_table(s, f"{folder}/events", events).select("event_uid", "visitor_key")


@query("person_changes", sql("SELECT tenant_id, order_id, person_id * 2 AS person_id, order_sequence FROM oc", "oc"), dates=())
def person_changes(s, d):
    """Persons that were split in two are merged by a second run, which brings every third order; only what changes is renumbered."""
    folder, orders, half = folder_of(s), ad.star_orders(s, d), F.col("order_id") % 2
    split = F.col("person_id") * 2 + half
    node = lambda kind, at, to: (F.lit(kind).alias("node_kind"), at.cast("bigint").alias("node_id"), to.cast("bigint").alias("person_id"))
    first, second = orders.where("order_id % 3 <> 0"), orders.where("order_id % 3 = 0")
    person_orders.apply_identity(s, folder, first.select("tenant_id", *node("order", F.col("order_id"), split)), first, c.store(s), 0)
    merged = second.select("tenant_id", *node("order", F.col("order_id"), F.col("person_id") * 2))
    merges = first.where(half == 1).select("tenant_id", *node("person", split, F.col("person_id") * 2)).distinct()
    person_orders.apply_identity(s, folder, merged.unionByName(merges), second, c.store(s), 1)
    found = person_orders.stored_orders(s, folder)
    return (identity.order_sequence(orders, c.store(s)) if found is None else found).select("tenant_id", "order_id", "person_id", "order_sequence")


query("orphan_events", sql("SELECT CAST(event_uid % 3 + 1 AS INT) AS tenant_id, event_uid FROM ev WHERE event_uid % 3 = 2", "ev"), dates=())(
    lambda s, d: privacy.orphan_events(ad.events(s, d).withColumn("tenant_id", (F.col("event_uid") % 3 + 1).cast("int")), ad.tenants(s)).select("tenant_id", "event_uid")
)


def _requests(s, d) -> DataFrame:
    e = F.col("event_id")
    return _raw(s, d).select(
        e.alias("request_id"), F.col("event_type").alias("topic"), F.concat(F.lit("p"), (e % 400).cast("string")).alias("payload"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("received_at"), F.when(F.col("k") % 3 == 0, F.col("ts").cast("timestamp")).alias("completed_at"),
    )


_REQ = f"SELECT event_id AS request_id, event_type AS topic, 'p' || (event_id % 400) AS payload, date_trunc('second', ts) AS received_at, CASE WHEN k % 3 = 0 THEN ts END AS completed_at FROM {_E}"


@query("request_dedup", f"SELECT request_id, topic, payload, received_at FROM (SELECT * FROM ({_REQ}) QUALIFY row_number() OVER (PARTITION BY topic, payload ORDER BY received_at, request_id) = 1) WHERE completed_at IS NULL AND received_at < TIMESTAMP '2024-01-30 00:00:00' ORDER BY received_at, request_id LIMIT 50", dates=())
def request_dedup(s, d):
    return privacy.request_dedup(_requests(s, d), NOW).select("request_id", "topic", "payload", "received_at")


# --- monitors --------------------------------------------------------------------------------------------------------


def _job_runs(s, d) -> DataFrame:
    job = F.when(F.col("event_type") == "view", "import").when(F.col("event_type") == "click", "rollup").when(F.col("event_type") == "signup", "compliance").otherwise("other")
    stop = F.when(F.col("event_type") == "click", "2024-01-20").otherwise("2024-02-01")
    return _raw(s, d).where(F.col("ts") < stop.cast("timestamp")).select(job.alias("job"), F.when(F.col("k") % 2 == 0, "ok").otherwise("failed").alias("status"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("finished_at"))


_LATE = f"""SELECT job, h, floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t)) / 3600) AS hours, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t) AS age FROM (
SELECT CASE event_type WHEN 'view' THEN 'import' WHEN 'click' THEN 'rollup' WHEN 'signup' THEN 'compliance' END AS job, max(date_trunc('second', ts)) AS t FROM {_E} WHERE k % 2 = 0 AND NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20 00:00:00') GROUP BY 1)
JOIN (VALUES ('import', 2), ('rollup', 3), ('compliance', 48)) v(job, h) USING (job)"""


@query("mon_freshness", f"SELECT 'stale:' || job AS alert_key, CASE WHEN age > h * 21600 THEN 'critical' ELSE 'warn' END AS severity, job || ' last succeeded ' || CAST(hours AS BIGINT) || ' hours ago' AS message FROM ({_LATE}) WHERE age > h * 3600", dates=())
def mon_freshness(s, d):
    return monitors.mon_freshness(_job_runs(s, d), NOW)


def _import_log(s, d) -> DataFrame:
    return _raw(s, d).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_name"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("imported_at"), F.concat(F.lit("bad line "), F.col("k").cast("string")).alias("message"))


@query("mon_import_failures", f"SELECT 'import:failed' AS alert_key, 'warn' AS severity, count(*) || ' files failed: ' || max('bad line ' || k) AS message FROM {_E} WHERE event_type = 'error' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-30 12:00:00' HAVING count(*) > 0", dates=())
def mon_import_failures(s, d):
    return monitors.mon_import_failures(_import_log(s, d), datetime(2024, 1, 30, 18))


@query("mon_backlog", "SELECT 'import:backlog' AS alert_key, CASE WHEN n > 500 THEN 'critical' WHEN m > 90 THEN 'warn' END AS severity, n || ' files wait, the oldest for ' || m || ' minutes' AS message FROM (SELECT count(*) AS n, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(min(date_trunc('second', ts)))) / 60) AS BIGINT) AS m FROM events WHERE event_type = 'error') WHERE n > 0", dates=())
def mon_backlog(s, d):
    log = _import_log(s, d)
    return monitors.mon_backlog(log.select("file_name", F.col("imported_at").alias("closed_at")), log, NOW)


@query("mon_backlog_files", f"SELECT 'import:backlog' AS alert_key, 'warn' AS severity, count(DISTINCT hour) AS hours FROM (SELECT {_MS} % 8 AS hour FROM {_E}) WHERE hour BETWEEN 3 AND 4 HAVING count(*) > 0", dates=())
def mon_backlog_files(s, d):
    """The monitor over a listing of landed files, of which those of the first three hours are imported."""
    folder, later = folder_of(s), datetime(2100, 1, 1)
    _write_feed(s, d, f"{folder}/feed")
    files = monitors.feed_files(s, f"{folder}/feed", datetime(2024, 1, 30, 5))
    hour = F.regexp_extract("file_path", r"hour=(\d{10})/", 1)
    done = monitors.listed_files(s, f"{folder}/feed").where(hour < "2024013003").select(F.regexp_extract("file_path", feeds.FEED_FILE, 1).alias("file_name"), F.lit("ok").alias("status"))
    waiting = monitors.listed_files(s, f"{folder}/feed").where((hour >= "2024013003") & (hour < "2024013005")).select(hour.alias("hour")).distinct()
    found = monitors.mon_backlog(files, done, later, most=10_000)
    return found.join(waiting.agg(F.count("*").alias("hours"))).select("alert_key", "severity", "hours")


@query("mon_capacity_files", sql("SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, true AS over FROM ev GROUP BY 1", "ev"), dates=())
def mon_capacity_files(s, d):
    """The monitor over the sizes of an event table's files, with a limit that each day is beyond."""
    folder = folder_of(s)
    sinks.sink_events(ad.events(s, d), f"{folder}/events")
    found = monitors.mon_capacity(monitors.file_sizes(s, f"{folder}/events", "event_date"), 1000)
    return found.select(F.substring_index("alert_key", ":", -1).alias("event_date"), (F.col("severity") == "critical").alias("over"))


_CAP = "SELECT event_type, CAST(sum(length(props) * 1000) AS BIGINT) AS b FROM events GROUP BY 1"


@query("mon_capacity", f"SELECT 'capacity:' || event_type AS alert_key, CASE WHEN p >= 95 THEN 'critical' ELSE 'warn' END AS severity, printf('%.1f', p) || '% used' AS message FROM (SELECT event_type, round(CAST(b AS DOUBLE) / CAST(floor(sum(b) OVER () * 0.21) AS BIGINT) * 100, 1) AS p FROM ({_CAP})) WHERE p >= 80", dates=())
def mon_capacity(s, d):
    sizes = _raw(s, d).select(F.col("event_type").alias("partition_key"), (F.length("props") * 1000).cast("bigint").alias("bytes"))
    return monitors.mon_capacity(sizes, int((sizes.agg(F.sum("bytes")).first()[0] or 5) * 0.21))


@query("mon_compliance", f"SELECT 'compliance:' || topic AS alert_key, CASE WHEN min(received_at) < TIMESTAMP '2024-01-29 00:00:00' THEN 'critical' ELSE 'warn' END AS severity, count(*) || ' requests open' AS message FROM ({_REQ}) WHERE completed_at IS NULL AND received_at < TIMESTAMP '2024-01-30 00:00:00' GROUP BY topic", dates=())
def mon_compliance(s, d):
    return monitors.mon_compliance(_requests(s, d), NOW)


@query("mon_alert_state", f"""SELECT alert_key, CASE WHEN f THEN 'warn' ELSE 'critical' END AS severity, CASE WHEN f THEN 'new' ELSE 'old' END AS message, CASE WHEN f THEN 'open' ELSE 'resolved' END AS status, CAST(coalesce(n, 0) + CAST(f AS INT) AS BIGINT) AS raise_count,
CASE WHEN f AND (st IS NULL OR st = 'resolved') THEN TIMESTAMP '2024-01-31 00:00:00' ELSE t END AS first_raised_at, CASE WHEN f THEN TIMESTAMP '2024-01-31 00:00:00' ELSE t END AS last_raised_at,
CASE WHEN f AND (st IS NULL OR st = 'resolved' OR t <= TIMESTAMP '2024-01-30 18:00:00') THEN TIMESTAMP '2024-01-31 00:00:00' ELSE t END AS notified_at, f AND (st IS NULL OR st = 'resolved' OR t <= TIMESTAMP '2024-01-30 18:00:00') AS notify
FROM (SELECT 'a' || event_id AS alert_key, event_id % 3 <> 1 AS f, CASE WHEN event_id % 2 = 0 THEN CASE WHEN k % 2 = 0 THEN 'resolved' ELSE 'open' END END AS st, CASE WHEN event_id % 2 = 0 THEN k END AS n, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS t FROM {_E}) WHERE f OR st IS NOT NULL""", dates=())
def mon_alert_state(s, d):
    e, at = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    key = F.concat(F.lit("a"), e.cast("string")).alias("alert_key")
    state = _raw(s, d).where(e % 2 == 0).select(key, F.lit("critical").alias("severity"), F.lit("old").alias("message"), F.when(F.col("k") % 2 == 0, "resolved").otherwise("open").alias("status"), F.col("k").alias("raise_count"), at.alias("first_raised_at"), at.alias("last_raised_at"), at.alias("notified_at"))
    found = _raw(s, d).where(e % 3 != 1).select(key, F.lit("warn").alias("severity"), F.lit("new").alias("message"))
    return monitors.mon_alert_state(state, found, NOW)


# --- sources and sinks -----------------------------------------------------------------------------------------------


def _write_feed(s, d, path: str) -> None:
    """Feed lines as NDJSON, a folder for each of eight hours."""
    lines = _lines(s, d).drop("_corrupt", "_file")
    hour = F.concat(F.lit("202401300"), (F.col("ts") % 8).cast("string"))
    lines.withColumn("hour", hour).write.partitionBy("hour").json(path)


@query("src_event_feed", f"SELECT '202401300' || ms % 8 AS hour, count(*) AS lines, count(DISTINCT id) AS ids FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN 'e' || event_id END AS id, {_MS} AS ms FROM {_E}) WHERE ms % 8 < 5 GROUP BY 1", dates=())
def src_event_feed(s, d):
    folder = folder_of(s)
    _write_feed(s, d, f"{folder}/feed")
    closed = feeds.src_event_feed(s, f"{folder}/feed", datetime(2024, 1, 30, 5))
    return closed.groupBy(F.col("_hour").alias("hour")).agg(F.count("*").alias("lines"), F.countDistinct("id").alias("ids"))


@query("src_orders_feed", f"SELECT o_orderkey AS order_id, o_custkey AS shopify_customer_id, {_MINOR} AS total_minor FROM orders", dates=())
def src_orders_feed(s, d):
    folder = folder_of(s)
    sinks.sink_orders_feed(raw_orders(s, d), f"{folder}/orders")
    return orders.orders_flatten(feeds.src_orders_feed(s, f"{folder}/orders")).select("order_id", "shopify_customer_id", "total_minor")


@query("src_bulk_export", "SELECT o_orderkey AS order_key, count(l_orderkey) AS lines, coalesce(CAST(sum(l_quantity) AS BIGINT), 0) AS units FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", dates=())
def src_bulk_export(s, d):
    folder = folder_of(s)
    gid = lambda c: F.concat(F.lit("gid://shop/Order/"), F.col(c).cast("string"))
    parents = ad.table(s, d, "orders").select(F.to_json(F.struct(gid("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))).alias("value"))
    kids = ad.table(s, d, "lineitem").select(F.to_json(F.struct(F.concat(F.lit("gid://shop/LineItem/"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_quantity").cast("bigint").alias("quantity"), gid("l_orderkey").alias("__parentId"))).alias("value"))
    parents.unionByName(kids).write.text(f"{folder}/bulk")
    got = feeds.src_bulk_export(s, f"{folder}/bulk", "id STRING, customer BIGINT", "id STRING, quantity BIGINT")
    units = F.aggregate("children", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"])
    return got.select(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint").alias("order_key"), F.size("children").cast("bigint").alias("lines"), units.alias("units"))


@query("src_geo_ranges", "SELECT k * 256 AS ip_start, k * 256 + 255 AS ip_end, count(*) AS events FROM (SELECT CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1, 2", dates=())
def src_geo_ranges(s, d):
    folder = folder_of(s)
    k = F.col("k")
    ranges = _raw(s, d).select((k * 256).alias("ip_start"), (k * 256 + 255).alias("ip_end"), *(F.lit("x").alias(n) for n in ("country", "region", "city")), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    ranges.write.parquet(f"{folder}/ranges")
    return feeds.src_geo_ranges(s, f"{folder}/ranges").groupBy("ip_start", "ip_end").agg(F.count("*").alias("events"))


@query("sink_events", sql("SELECT CAST(occurred_at AS DATE) AS event_date, count(*) AS events, CAST(sum(event_uid) AS BIGINT) AS uid_sum FROM ev GROUP BY 1", "ev"), dates=("event_date",))
def sink_events(s, d):
    folder = folder_of(s)
    sinks.sink_events(ad.events(s, d), f"{folder}/events")
    return s.read.parquet(f"{folder}/events").groupBy("event_date").agg(F.count("*").alias("events"), F.sum("event_uid").alias("uid_sum"))


@query("sink_rollup", sql("SELECT stat_date, sessions FROM (SELECT stat_date, CAST(sum(starts) AS BIGINT) AS sessions FROM marked GROUP BY 1)", "marked"))
def sink_rollup(s, d):
    folder = folder_of(s)
    days = rollups.sessions_daily(c.ev(s, d))
    sinks.sink_rollup(days.withColumn("sessions", F.lit(-1).cast("bigint")), f"{folder}/rollup")
    sinks.sink_rollup(days, f"{folder}/rollup")  # replaces, never adds
    return s.read.parquet(f"{folder}/rollup").select(F.col("stat_date").cast("date").alias("stat_date"), "sessions")


# --- streams ---------------------------------------------------------------------------------------------------------


def _arriving(s, d) -> DataFrame:
    """The event table as a file stream."""
    schema = ad.table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.lit(1).alias("tenant_id"), F.col("event_id").alias("event_uid"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("occurred_at"), F.col("ts").cast("timestamp").alias("received_at"), F.col("user_id").alias("visitor_key"), "event_type", "value")


def _collected(s, stream: DataFrame, mode: str) -> DataFrame:
    """Run a bounded stream to its end and read what it wrote (the last complete result in complete mode)."""
    folder = folder_of(s)

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "append":
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").select(*stream.columns)


@query("stream_dedup", sql("SELECT tenant_id, event_uid, occurred_at FROM ev", "ev"), dates=())
def stream_dedup(s, d):
    twice = _arriving(s, d)
    return _collected(s, streams.stream_dedup(twice.unionByName(_arriving(s, d))).select("tenant_id", "event_uid", "occurred_at"), "append")


@query("stream_rate_counts", "SELECT date_trunc('minute', ts) AS minute, '10.0.0.' || (user_id % 3) AS ip, count(*) AS batches, CAST(greatest(count(*) - 1, 0) AS BIGINT) AS dropped FROM events GROUP BY 1, 2", dates=())
def stream_rate_counts(s, d):
    batches = _arriving(s, d).withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("visitor_key") % 3).cast("string")))
    return _collected(s, streams.stream_rate_counts(batches, most=1), "complete")


@query("stream_rate_limit", "SELECT event_id AS batch_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 3, date_trunc('day', ts) ORDER BY ts, event_id) <= 3", dates=())
def stream_rate_limit(s, d):
    """Days are shrunk to minutes, so addresses send more than the limit; the stream stops and goes on after half of its files."""
    folder = folder_of(s)
    at = F.col("ts").cast("timestamp")
    shrunk = F.timestamp_millis((F.unix_date(F.to_date(at)).cast("long") * 60_000 + F.floor((F.unix_millis(at) - F.unix_millis(F.date_trunc("day", at))) / 1440)).cast("long"))
    rows = _raw(s, d).select(F.col("event_id").alias("batch_id"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 3).cast("string")).alias("ip"), shrunk.alias("received_at"), at.alias("ts"), F.dayofmonth("ts").alias("day"))
    schema = "batch_id BIGINT, ip STRING, received_at TIMESTAMP, ts TIMESTAMP"
    for k, part in enumerate(("day <= 10", "day > 10 and day <= 20", "day > 20")):
        rows.where(part).select("batch_id", "ip", "received_at", "ts").coalesce(1).write.parquet(f"{folder}/feed/part={k}")
        source = s.readStream.schema(schema).parquet(f"{folder}/feed/*")
        # within a minute the order is that of the unshrunk times
        source = source.withColumn("batch_id", F.struct("ts", F.col("batch_id").alias("id"))).select("batch_id", "ip", F.date_trunc("minute", "received_at").alias("received_at"))
        streams.stream_rate_limit(source, f"{folder}/out", f"{folder}/checkpoint", most=3).awaitTermination()
    return streams.read_passed(s, f"{folder}/out").select(F.col("batch_id.id").alias("batch_id"))


@query("stream_session_windows", sql("""SELECT tenant_id, visitor_key, min(occurred_at) AS started_at, max(occurred_at) + INTERVAL 30 MINUTE AS ends_at, count(*) AS events FROM (
SELECT *, sum(fresh) OVER (PARTITION BY visitor_key ORDER BY occurred_at, event_uid) AS n FROM (SELECT *, CASE WHEN lag(occurred_at) OVER (PARTITION BY visitor_key ORDER BY occurred_at, event_uid) > occurred_at - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY tenant_id, visitor_key, n""", "ev"), dates=())
def stream_session_windows(s, d):
    return _collected(s, streams.stream_session_windows(_arriving(s, d)), "complete")


@query("stream_sessions", sql("SELECT stat_date, CAST(sum(starts) AS BIGINT) AS sessions FROM marked GROUP BY 1", "marked"))
def stream_sessions(s, d):
    """Half of the events arrive late, after a restart."""
    folder = folder_of(s)
    for k in range(2):
        ad.events(s, d).where(F.col("event_uid") % 2 == k).write.parquet(f"{folder}/feed/part={k}")
        source = s.readStream.schema(ad.events(s, d).schema).parquet(f"{folder}/feed/*")
        streams.stream_sessions(source, f"{folder}/slots", f"{folder}/rollup", f"{folder}/checkpoint", c.store(s)).awaitTermination()
    return s.read.parquet(f"{folder}/rollup").select(F.col("stat_date").cast("date").alias("stat_date"), "sessions")


@query("stream_kpi", sql("SELECT stat_date, sessions FROM (SELECT stat_date, CAST(sum(starts) AS BIGINT) AS sessions FROM marked GROUP BY 1) WHERE stat_date > DATE '2024-01-28'", "marked"))
def stream_kpi(s, d):
    folder = folder_of(s)
    ad.events(s, d).withColumn("event_date", F.to_date("occurred_at")).write.partitionBy("event_date").parquet(f"{folder}/events")
    day_of = lambda df: rollups.with_day(df, c.store(s), "occurred_at")
    is_open = lambda days: rollups.with_provisional(days, c.store(s), ad.NOW_EVENTS).where("is_provisional = 1").drop("is_provisional")
    streams.stream_kpi(_arriving(s, d), f"{folder}/events", f"{folder}/rollup", f"{folder}/checkpoint", lambda e, days: rollups.sessions_daily(e), day_of, is_open).awaitTermination()
    return s.read.parquet(f"{folder}/rollup").select(F.col("stat_date").cast("date").alias("stat_date"), "sessions")


_TYPED = f"SELECT {_UID} AS event_uid, date_trunc('second', CASE WHEN k % 10 = 0 THEN ts + INTERVAL 5 SECOND ELSE ts END) AS occurred_at, CAST({_CODE} AS INT) AS event_type, date_trunc('second', ts + INTERVAL 5 SECOND) AS received_at, {_MS} % 8 AS hour FROM {_E} WHERE {_CODE} IS NOT NULL"


@query("stream_ingest", f"SELECT event_uid, occurred_at, event_type FROM ({_TYPED}) WHERE hour < 5 QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY received_at, occurred_at) = 1", dates=())
def stream_ingest(s, d):
    folder = folder_of(s)
    _write_feed(s, d, f"{folder}/feed")
    _write_feed(s, d, f"{folder}/feed/again")  # replays add nothing
    now = datetime(2024, 1, 30, 5)  # three of eight hours are not closed
    streams.stream_ingest(s, f"{folder}/feed", f"{folder}/events", f"{folder}/checkpoint", _salted(s), lambda: now, max_files=1000).awaitTermination()
    return s.read.parquet(f"{folder}/events").select("event_uid", "occurred_at", "event_type")


@query("stream_ingest_audit", f"""SELECT CAST(2 * count(*) FILTER (c IS NOT NULL) AS BIGINT) AS typed_lines, CAST(2 * count(*) FILTER (c IS NULL) AS BIGINT) AS skipped, count(DISTINCT u) FILTER (c IS NOT NULL) AS accepted, CAST(0 AS BIGINT) AS malformed
FROM (SELECT {_CODE} AS c, {_UID} AS u, {_MS} % 8 AS hour FROM {_E}) WHERE hour < 5""", dates=())
def stream_ingest_audit(s, d):
    folder = folder_of(s)
    _write_feed(s, d, f"{folder}/feed")
    _write_feed(s, d, f"{folder}/feed/again")
    streams.stream_ingest(s, f"{folder}/feed", f"{folder}/events", f"{folder}/checkpoint", _salted(s), lambda: datetime(2024, 1, 30, 5), max_files=1000, audit=f"{folder}/audit").awaitTermination()
    counts = s.read.parquet(f"{folder}/audit")
    return counts.agg((F.sum("accepted") + F.sum("duplicate")).alias("typed_lines"), *(F.sum(c).alias(c) for c in ("skipped", "accepted", "malformed")))


@query("stream_ingest_replays", f"SELECT event_uid, occurred_at, event_type FROM ({_TYPED}) QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY received_at, occurred_at) = 1", dates=())
def stream_ingest_replays(s, d):
    """All lines are sent again three days later, which moves those with an impossible clock to other days; another checkpoint reads all files twice."""
    folder = folder_of(s)
    lines = _lines(s, d).drop("_corrupt", "_file")
    lines.withColumn("hour", F.lit("2024013000")).write.partitionBy("hour").json(f"{folder}/feed")
    now = lambda: datetime(2024, 1, 30, 5)
    for checkpoint in ("one", "one", "two"):
        streams.stream_ingest(s, f"{folder}/feed", f"{folder}/events", f"{folder}/{checkpoint}", _salted(s), now, max_files=1000).awaitTermination()
        if checkpoint == "one":
            later = lines.withColumn("_rx", F.col("_rx") + 3 * 86_400_000).withColumn("hour", F.lit("2024013001"))
            later.write.mode("append").partitionBy("hour").json(f"{folder}/feed")
    return s.read.parquet(f"{folder}/events").select("event_uid", "occurred_at", "event_type")


_ROUTED = f"""SELECT event_uid, max(CAST(occurred_at AS DATE)) OVER (PARTITION BY file) > DATE '2024-01-20' AS waits FROM (
SELECT {_UID} AS event_uid, CASE WHEN k % 10 = 0 THEN ts + INTERVAL 5 SECOND ELSE ts END AS occurred_at, CAST(ts + to_days(CAST(k % 4 AS INT)) AS DATE) AS file FROM {_E} WHERE {_CODE} IS NOT NULL)"""


@query("stream_ingest_held", f"SELECT event_uid, count(*) AS copies FROM (SELECT DISTINCT event_uid FROM ({_ROUTED}) WHERE NOT waits) GROUP BY 1", dates=())
def stream_ingest_held(s, d):
    """A file with an event of a day without a place is held as a whole; files hold events of four days."""
    folder = folder_of(s)
    at = F.timestamp_millis(F.col("_rx") - 5000)
    late = F.regexp_extract("u", r"products/(\d+)", 1).cast("int") % 4
    lines = _lines(s, d).drop("_corrupt", "_file").withColumn("hour", F.concat(F.date_format(F.date_add(F.to_date(at), late), "yyyyMMdd"), F.lit("00")))
    lines.repartition("hour").write.partitionBy("hour").json(f"{folder}/feed")
    registry = s.sql("SELECT 1 AS shard_id, DATE'2024-01-01' AS valid_from, DATE'2024-01-20' AS valid_to")
    streams.stream_ingest(s, f"{folder}/feed", f"{folder}/events", f"{folder}/checkpoint", _salted(s), lambda: datetime(2024, 3, 1), max_files=1000, registry=registry).awaitTermination()
    return s.read.parquet(f"{folder}/events").groupBy("event_uid").agg(F.count("*").alias("copies"))


def _late_versions(s, d) -> DataFrame:
    """Three versions of every order; what the middle one says first stays hidden behind the older one."""
    o, at = F.col("order_id"), F.col("created_at")
    base = ad.star_orders(s, d).select("tenant_id", "order_id", "created_at", "total_minor", "person_id")
    version = lambda k, site, mail: base.select(
        "tenant_id", "order_id", (at + F.expr(f"INTERVAL {k} HOURS")).alias("created_at"), (at + F.expr(f"INTERVAL {k} HOURS")).alias("updated_at"), F.lit(f"C{k}").alias("currency"),
        site.alias("landing_site"), (F.col("total_minor") + k).alias("total_minor"), mail.alias("email_hash"),
    )
    hashed = F.concat(F.lit("h"), F.col("person_id").cast("string"))
    none = F.lit(None).cast("string")
    return version(0, F.when(o % 4 != 0, "/first"), hashed).unionByName(version(1, F.lit("/second"), F.when(o % 3 == 0, "middle"))).unionByName(version(2, F.lit("/third"), none))


_LATE_ORDERS = sql("SELECT tenant_id, order_id, created_at, created_at + INTERVAL 2 HOUR AS updated_at, 'C0' AS currency, CASE WHEN order_id % 4 <> 0 THEN '/first' END AS landing_site, total_minor + 2 AS total_minor, CASE WHEN order_id % 3 = 0 THEN 'middle' ELSE 'h' || person_id END AS email_hash FROM oc", "oc")


@query("orders_merge_steps", _LATE_ORDERS, dates=())
def orders_merge_steps(s, d):
    """Versions merged in two steps: the first and the third, then the one between."""
    states = orders.order_states(_late_versions(s, d))
    early = orders.fold_states(states.where("currency <> 'C1'"))
    return orders.orders_of_states(orders.fold_states(early.unionByName(states.where("currency = 'C1'"))))


@query("stream_order_merge_late", _LATE_ORDERS, dates=())
def stream_order_merge_late(s, d):
    folder = folder_of(s)
    versions = _late_versions(s, d)
    for k in (2, 0, 1):  # the newest arrives first
        versions.where(F.col("currency") == f"C{k}").write.parquet(f"{folder}/feed/part={k}")
        run = streams.stream_order_merge(s.readStream.schema(versions.schema).parquet(f"{folder}/feed/*"), f"{folder}/orders", f"{folder}/checkpoint")
        run.processAllAvailable()
        run.stop()
    return streams.read_orders(s, f"{folder}/orders").select(*versions.columns)


@query("stream_order_merge", sql("SELECT order_id, CASE WHEN order_id % 3 = 0 THEN total_minor + 1 ELSE total_minor END AS total_minor FROM oc", "oc"), dates=())
def stream_order_merge(s, d):
    folder = folder_of(s)
    versions = _versions(s, d)
    for k, kept in enumerate(("order_id % 3 <> 0 or currency = 'INR'", "currency = 'USD'")):
        versions.where(kept).write.parquet(f"{folder}/feed/part={k}")
    source = s.readStream.schema(versions.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/feed/*")
    run = streams.stream_order_merge(source, f"{folder}/orders", f"{folder}/checkpoint")
    run.processAllAvailable()
    run.stop()
    return streams.read_orders(s, f"{folder}/orders").select("order_id", "total_minor")
