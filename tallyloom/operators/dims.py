"""Dimensions: one row per natural key, with a 63-bit digest of it as the id, so facts and dimensions agree without look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import browser, device_type, fitted, hex_digest, key63, operating_system, page_type, query_value, url_part

UTM = ("source", "medium", "campaign", "content", "term")
_SEPARATOR = "\x1f"


def dim_intern(df: DataFrame, keys: list[str], id_column: str, stored: DataFrame | None = None) -> DataFrame:
    """Natural keys not yet in ``stored``, with their id; null keys stay out."""
    text = F.concat_ws(_SEPARATOR, *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    fresh = df.select(*keys).where(F.coalesce(*(F.col(k) for k in keys)).isNotNull()).distinct().withColumn(id_column, key63(text))
    return fresh if stored is None else fresh.join(stored.select(id_column), id_column, "left_anti")


def visitor_hash(client_id: Column, tenant_salt: Column) -> Column:
    return hex_digest(F.concat(tenant_salt, F.lit(":"), client_id))


def dim_visitor(events: DataFrame, client_id: str = "client_id", salt: str = "salt") -> DataFrame:
    """Salted digest of the client id with first and last time; an empty id is no visitor of its own."""
    named = events.where(F.coalesce(F.col(client_id), F.lit("")) != "").withColumn("visitor_hash", visitor_hash(F.col(client_id), F.col(salt)))
    seen = named.groupBy("tenant_id", "visitor_hash").agg(F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))
    return seen.withColumn("visitor_key", key63(F.concat(F.col("tenant_id").cast("string"), F.lit(":"), F.col("visitor_hash"))))


def path_of(url: Column) -> Column:
    return F.left(F.coalesce(url_part(url, "path"), F.lit("/")), F.lit(512))


def path_key(url: Column) -> Column:
    return F.when(F.length(url) > 0, key63(path_of(url)))


def dim_path(rows: DataFrame, url: str = "url") -> DataFrame:
    """``tenant_id, path_id, path, page_type`` of all URLs."""
    paths = rows.where(F.length(url) > 0).select("tenant_id", path_of(F.col(url)).alias("path")).distinct()
    return paths.select("tenant_id", key63(F.col("path")).alias("path_id"), "path", page_type(F.col("path")).alias("page_type"))


def referrer_key(url: Column) -> Column:
    return F.when(F.length(url) > 0, key63(F.left(url, F.lit(512))))


def dim_referrer(rows: DataFrame, url: str = "referrer") -> DataFrame:
    urls = rows.where(F.length(url) > 0).select("tenant_id", F.left(F.col(url), F.lit(512)).alias("referrer_url")).distinct()
    host = fitted(url_part(F.col("referrer_url"), "host"), 191)
    return urls.select("tenant_id", key63(F.col("referrer_url")).alias("referrer_id"), host.alias("referrer_host"), "referrer_url")


def campaign_columns(url: Column) -> dict[str, Column]:
    """The seven columns of a campaign and its id (null if the URL has no attribution at all)."""
    query = F.coalesce(url_part(url, "query"), F.lit(""))
    utm = {f"utm_{k}": fitted(query_value(query, f"utm_{k}"), 191) for k in UTM}
    flags = {f"has_{k}": query_value(query, k).isNotNull() for k in ("gclid", "fbclid")}
    return {**utm, **flags}


def with_campaign(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add the campaign columns and ``campaign_id``."""
    tagged = rows.withColumns(campaign_columns(F.col(url)))
    text = F.concat_ws(_SEPARATOR, *(F.coalesce(f"utm_{k}", F.lit("")) for k in UTM), F.col("has_gclid").cast("int").cast("string"), F.col("has_fbclid").cast("int").cast("string"))
    some = F.coalesce(*(F.col(f"utm_{k}") for k in UTM)).isNotNull() | F.col("has_gclid") | F.col("has_fbclid")
    return tagged.withColumn("campaign_id", F.when(some, key63(text)))


def dim_campaign(rows: DataFrame, url: str = "url") -> DataFrame:
    tagged = with_campaign(rows, url).where("campaign_id is not null")
    return tagged.select("tenant_id", "campaign_id", *(f"utm_{k}" for k in UTM), "has_gclid", "has_fbclid").distinct()


def agent_key(agent: Column) -> Column:
    return F.when(F.length(agent) > 0, key63(F.left(agent, F.lit(400))))


def dim_useragent(rows: DataFrame, agent: str = "user_agent") -> DataFrame:
    agents = rows.where(F.length(agent) > 0).select("tenant_id", F.left(F.col(agent), F.lit(400)).alias("user_agent")).distinct()
    ua = F.col("user_agent")
    return agents.select("tenant_id", agent_key(ua).alias("ua_id"), "user_agent", device_type(ua).alias("device_type"), browser(ua).alias("browser"), operating_system(ua).alias("os"))


def geo_key(country: Column, region: Column, city: Column) -> Column:
    parts = [F.lower(F.coalesce(c, F.lit(""))) for c in (country, region, city)]
    return F.when(F.concat(*parts) != "", key63(F.concat_ws(_SEPARATOR, *parts)))


def dim_geo(rows: DataFrame) -> DataFrame:
    """Places of all tenants; one spelling and position of each is kept."""
    key = geo_key(F.col("country"), F.col("region"), F.col("city"))
    return rows.withColumn("geo_id", key).where("geo_id is not null").groupBy("geo_id").agg(
        *(F.min(c).alias(c) for c in ("country", "region", "city")), F.min("lat").alias("lat"), F.min("lon").alias("lon")
    )


def dim_search_term(rows: DataFrame, term: str = "term") -> DataFrame:
    """Terms without regard to case; the first spelling is kept."""
    cut = rows.withColumn("_t", fitted(F.col(term), 255)).where("_t is not null")
    key = F.lower("_t")
    first = cut.groupBy("tenant_id", key.alias("_key")).agg(F.min_by("_t", F.struct("occurred_at", "event_uid")).alias("term"))
    return first.select("tenant_id", key63(F.col("_key")).alias("search_term_id"), "term")


def dim_click_target(rows: DataFrame) -> DataFrame:
    return dim_intern_per_tenant(rows, ["label", "selector", "href"], "click_target_id")


def dim_intern_per_tenant(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    text = F.concat_ws(_SEPARATOR, *(F.coalesce(F.col(k), F.lit("")) for k in keys))
    return df.select("tenant_id", *keys).where(F.coalesce(*(F.col(k) for k in keys)).isNotNull()).distinct().withColumn(id_column, key63(text))
