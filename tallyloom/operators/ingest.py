"""From batches to typed events: gate, map, shred, deduplicate, audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import I63, U16, U32, fitted, ip_number, key63, unsigned, url_part
from tallyloom.functions.small import small_table
from tallyloom.operators.dims import agent_key, path_key, referrer_key, visitor_hash, with_campaign
from tallyloom.schemas import CURRENCIES, EVENT_CODES, THEME

MAX_BATCH_BYTES, MAX_BATCH_EVENTS, MAX_BATCHES_A_MINUTE = 65_536, 100, 240


def ingest_gate(batches: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add ``tenant_id`` and ``reject_reason`` (null: accepted) to batches with ``body, write_key, n_events``."""
    known = tenants.where("status = 'active'").select("write_key", "tenant_id")
    joined = batches.join(known, "write_key", "left")
    reason = (
        F.when(F.octet_length("body") > MAX_BATCH_BYTES, "too_large").when(F.coalesce("n_events", F.lit(0)) == 0, "empty")
        .when(F.col("n_events") > MAX_BATCH_EVENTS, "too_many_events").when(F.col("tenant_id").isNull(), "unknown_key")
    )
    return joined.withColumn("reject_reason", reason)


def ingest_origin_check(batches: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add ``origin_ok``: the sender's host is one of the tenant's domains or below one; no host passes."""
    domains = F.filter(F.array(F.lower("shop_domain"), F.lower("custom_domain")), lambda d: F.coalesce(d, F.lit("")) != "")
    allowed = tenants.select("tenant_id", domains.alias("_domains"))
    host = F.coalesce(url_part(F.col("origin"), "host"), F.lit(""))
    fits = F.exists("_domains", lambda d: (F.col("_host") == d) | F.col("_host").endswith(F.concat(F.lit("."), d)))
    joined = batches.withColumn("_host", host).join(allowed, "tenant_id", "left")
    return joined.withColumn("origin_ok", (F.col("_host") == "") | F.coalesce(fits, F.lit(False))).drop("_host", "_domains")


def ingest_rate_limit(batches: DataFrame, most: int = MAX_BATCHES_A_MINUTE, place: str | None = None) -> DataFrame:
    """The first ``most`` batches of each address and UTC minute; ``place`` names a column for a batch's place in its minute."""
    minute = F.date_trunc("minute", F.col("received_at"))
    number = F.row_number().over(Window.partitionBy("ip", "_minute").orderBy("received_at", "batch_id"))
    first = batches.withColumn("_minute", minute).withColumn("_place", number).where(F.col("_place") <= most)
    return first.drop("_minute", "_place") if place is None else first.drop("_minute").withColumnRenamed("_place", place)


def ingest_explode(batches: DataFrame) -> DataFrame:
    """One row per event, stamped with what the batch knows."""
    return batches.select("tenant_id", "ip", F.left("user_agent", F.lit(400)).alias("user_agent"), "received_at", F.explode("e").alias("e")).select(
        "tenant_id", "ip", "user_agent", "received_at", "e.*"
    )


def event_codes(spark) -> DataFrame:
    return small_table(spark, [(s, n, c) for s, names in EVENT_CODES.items() for n, c in names.items()], "source INT, name STRING, event_type INT")


def event_map_type(raw: DataFrame, name: str = "n", source: str = "s") -> DataFrame:
    """Add ``source`` and ``event_type``; names that are not subscribed get null (skipped, not an error)."""
    kind = F.when(F.col(source) == THEME, F.lit(THEME)).otherwise(F.lit(1))
    codes = F.broadcast(event_codes(raw.sparkSession).withColumnsRenamed({"source": "_s", "name": "_n"}))
    joined = raw.withColumn("source", kind).join(codes, (F.col("source") == F.col("_s")) & (F.lower(F.trim(F.col(name))) == F.col("_n")), "left")
    return joined.drop("_s", "_n")


def _clock(ms: Column, received: Column, now: datetime) -> Column:
    """The client's time if it is after 2000 and before tomorrow, else the receive time, else now; whole seconds."""
    at_now = F.lit(now).cast("timestamp")
    client = F.when((ms > 946_684_800_000) & (ms < (at_now.cast("long") + 86_400) * 1000), F.timestamp_millis(ms))
    return F.date_trunc("second", F.coalesce(client, F.timestamp_millis(received), at_now))


def _millis(ts: Column) -> Column:
    """What a client sends as its time: a number, or text that starts with one; without its fraction."""
    return F.regexp_extract(ts.cast("string"), r"^\s*([+-]?\d{1,18}(?:\.\d+)?(?:[eE][+-]?\d{1,3})?)", 1).try_cast("double").try_cast("bigint")


def _identity() -> Column:
    """An event's own id, or a digest of its content where it has none."""
    content = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("cid", "n", "ts", "u", "p")))
    return F.when(F.length("id") > 0, F.col("id")).otherwise(F.concat(F.lit("syn:"), F.sha2(F.to_json(content).cast("binary"), 256)))


def event_shred(mapped: DataFrame, tenants: DataFrame, now: datetime) -> DataFrame:
    """Raw lines with ``event_type`` to typed rows; ``tenants`` needs ``salt``.

    Numbers that are none, or negative, become null; too large ones are clamped. Money arrives in minor units. A currency
    code that is not in CURRENCIES, in either case, becomes null."""
    salts = tenants.select(F.col("tenant_id").alias("_t"), F.col("salt").alias("_salt"))
    rows = mapped.where("event_type is not null").join(salts, "_t")
    tenant = F.col("_t").cast("string")
    client = visitor_hash(F.col("cid"), F.col("_salt"))
    shown = with_campaign(rows, "u")
    term = fitted(F.col("st"), 255)
    return shown.select(
        F.col("_t").alias("tenant_id"), key63(F.concat(tenant, F.lit(":"), _identity())).alias("event_uid"),
        _clock(_millis(F.col("ts")), F.col("_rx"), now).alias("occurred_at"), F.date_trunc("second", F.timestamp_millis("_rx")).alias("received_at"),
        "event_type", "source",
        F.when(F.coalesce("cid", F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(key63(F.concat(tenant, F.lit(":"), client))).alias("visitor_key"),
        unsigned(F.col("cu"), I63).alias("customer_ref"), path_key(F.col("u")).alias("path_id"), referrer_key(F.col("r")).alias("referrer_id"), "campaign_id",
        agent_key(F.col("_ua")).alias("ua_id"), unsigned(F.col("p"), I63).alias("product_id"),
        unsigned(F.col("v"), I63).alias("variant_id"), unsigned(F.col("q"), U16).cast("int").alias("qty"),
        unsigned(F.col("a"), U32).alias("amount_minor"), F.when(F.upper(F.trim("c")).isin(*CURRENCIES), F.upper(F.trim("c"))).alias("currency"),
        F.when(F.length("ct") > 0, key63(F.col("ct"))).alias("checkout_token"), unsigned(F.col("o"), I63).alias("order_ref"),
        F.when(term.isNotNull(), key63(F.lower(term))).alias("search_term_id"),
        F.when(F.col("cl").isNotNull(), key63(F.concat_ws("\x1f", *(F.coalesce(F.col(f"cl.{k}"), F.lit("")) for k in "tsh")))).alias("click_target_id"),
        F.col("_ip").alias("ip"), "_file",
    )


def event_dedup(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (tenant_id, event_uid), the first received; keys that are stored already are replays."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "event_uid").orderBy("received_at", "occurred_at"))
    once = events.withColumn("_n", first).where("_n = 1").drop("_n")
    return once if stored is None else once.join(stored.select("tenant_id", "event_uid"), ["tenant_id", "event_uid"], "left_anti")


def import_audit(classified: DataFrame) -> DataFrame:
    """Per file: accepted, duplicates, skipped, malformed and a status. ``classified`` has ``file_name, outcome``.

    A file with lines that are held back has failed, as has one of which nothing could be read."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "duplicate", "skipped", "malformed")]
    status = F.when((F.col("_held") > 0) | (F.col("accepted") + F.col("duplicate") == 0) & (F.col("malformed") > 0), "failed").otherwise("ok")
    return classified.groupBy("file_name").agg(*counts, F.count_if(F.col("outcome") == "held").alias("_held")).withColumn("status", status).drop("_held")


def classify_lines(raw: DataFrame, stored: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """``file_name, outcome`` of each line: malformed, skipped, duplicate, accepted, or held (in a file of ``held``: ``_file``)."""
    tenant = F.col("_t").cast("string")
    key = key63(F.concat(tenant, F.lit(":"), _identity()))
    if held is None:
        raw = raw.withColumn("_waits", F.lit(False))
    else:
        waiting = held.select("_file", F.lit(True).alias("_waits")).distinct()
        raw = raw.join(F.broadcast(waiting), "_file", "left").withColumn("_waits", F.coalesce("_waits", F.lit(False)))
    keyed = raw.withColumn("_key", F.when(F.col("_corrupt").isNull() & F.col("event_type").isNotNull() & ~F.col("_waits"), key))
    # lines without a key get negative numbers, which are no keys, so that they do not meet in one task
    keyed = keyed.withColumn("_spread", F.coalesce("_key", -1 - F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("_t", "_spread").orderBy("_rx", "_file"))
    keyed = keyed.withColumn("_n", F.when(F.col("_key").isNotNull(), place))
    if stored is not None:
        old = stored.select(F.col("tenant_id").alias("_t"), F.col("event_uid").alias("_spread"), F.lit(True).alias("_old")).distinct()
        keyed = keyed.join(old, ["_t", "_spread"], "left")
    else:
        keyed = keyed.withColumn("_old", F.lit(None).cast("boolean"))
    outcome = (
        F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.col("event_type").isNull(), "skipped")
        .when(F.col("_waits"), "held").when((F.col("_n") > 1) | F.coalesce("_old", F.lit(False)), "duplicate").otherwise("accepted")
    )
    return keyed.select(F.col("_file").alias("file_name"), outcome.alias("outcome"))


def event_route(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``shard_id`` from date ranges (``shard_id, valid_from, valid_to``); null means quarantine.

    The registry has a row a year and is broadcast.
    """
    day = F.to_date("occurred_at")
    ranges = F.broadcast(registry.select("shard_id", "valid_from", "valid_to"))
    return events.join(ranges, (day >= F.col("valid_from")) & (day <= F.col("valid_to")), "left").drop("valid_from", "valid_to")


#: Up to so many ranges the table is broadcast (about 100 bytes each).
MAX_BROADCAST_RANGES = 500_000


def geo_enrich(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Replace the address by ``country, region, city, lat, lon``; unknown addresses get nulls.

    Only distinct addresses are looked up. Ranges are cut at /16 borders, so the look-up is an equi-join on the prefix
    with a range check, not a nested loop.
    """
    addresses = rows.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("_n", ip_number(F.col(ip)))
    places = ranges.withColumn("_prefix", F.explode(F.sequence(F.shiftright("ip_start", 16), F.shiftright("ip_end", 16))))
    if ranges.limit(MAX_BROADCAST_RANGES + 1).count() <= MAX_BROADCAST_RANGES:
        places = F.broadcast(places)
    found = addresses.withColumn("_prefix", F.shiftright("_n", 16)).join(places, "_prefix")
    found = found.where(F.col("_n").between(F.col("ip_start"), F.col("ip_end")))
    # the narrowest range wins where ranges overlap
    picked = found.groupBy(ip).agg(F.min_by(F.struct("country", "region", "city", "lat", "lon"), F.struct(F.col("ip_end") - F.col("ip_start"), "ip_start")).alias("_g"))
    return rows.join(picked, ip, "left").select(*(c for c in rows.columns if c != ip), "_g.country", "_g.region", "_g.city", "_g.lat", "_g.lon")
