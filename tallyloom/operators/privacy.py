"""Deletion: due stores, purges, redaction of a person, orphans, compliance requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLLUPS_KEPT = True
#: Up to so many purged tenants are broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_TENANTS = 100_000
#: What a tombstone keeps nothing of, where the column exists.
SECRETS = ("admin_token_enc", "refresh_token_enc", "token_expires_at", "refresh_expires_at", "custom_domain", "salt")


def purge_due(tenants: DataFrame, now: datetime | str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return tenants.where((F.col("status") == "uninstalled") & (F.col("purge_after") <= at) & F.col("purged_at").isNull())


def purge_store(tables: dict[str, DataFrame], due: DataFrame, rollups: tuple[str, ...] = (), keep_rollups: bool = ROLLUPS_KEPT) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the due tenants' rows, and ``table_name, tenant_id, rows_removed``.

    Tables that are named in ``rollups`` stay whole while ``keep_rollups``.
    """
    gone = due.select("tenant_id").distinct()
    if gone.count() <= BROADCAST_TENANTS:
        gone = F.broadcast(gone)
    kept, counts = {}, None
    for name, df in tables.items():
        if name in rollups and keep_rollups:
            kept[name] = df
            continue
        kept[name] = df.join(gone, "tenant_id", "left_anti")
        removed = df.join(gone, "tenant_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("rows_removed"))
        removed = removed.select(F.lit(name).alias("table_name"), "tenant_id", "rows_removed")
        counts = removed if counts is None else counts.unionByName(removed)
    return kept, counts


def purge_tombstone(tenants: DataFrame, due: DataFrame, now: datetime | str) -> DataFrame:
    """The tenants after a purge: the purged ones stay as uninstalled, with the time and without tokens, domain and salt."""
    marked = tenants.join(due.select("tenant_id", F.lit(True).alias("_gone")).distinct(), "tenant_id", "left")
    gone = F.col("_gone").isNotNull()
    changed = {c: F.when(~gone, F.col(c)) for c in SECRETS if c in tenants.columns}
    changed |= {"status": F.when(gone, "uninstalled").otherwise(F.col("status")), "purged_at": F.when(gone, F.lit(now).cast("timestamp")).otherwise(F.col("purged_at"))}
    return marked.withColumns(changed).select(*tenants.columns)


def _marked(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_hit`` set where ``column`` is among the tenant's ``wanted`` values (``tenant_id, value``, distinct)."""
    named = wanted.select("tenant_id", F.col("value").alias(column), F.lit(True).alias("_new"))
    joined = df.join(named, ["tenant_id", column], "left")
    hit = F.coalesce("_new", F.lit(False))
    return joined.withColumn("_hit", F.col("_hit") | hit if "_hit" in df.columns else hit).drop("_new")


def _cleared(df: DataFrame, marks: list[tuple[DataFrame, str]], columns: tuple[str, ...]) -> DataFrame:
    marked = df
    for wanted, column in marks:
        if column in df.columns:
            marked = _marked(marked, wanted, column)
    if "_hit" not in marked.columns:
        return df
    return marked.withColumns({c: F.when(~F.col("_hit"), F.col(c)) for c in columns if c in df.columns}).select(*df.columns)


def _without(df: DataFrame, marks: list[tuple[DataFrame, str]]) -> DataFrame:
    marked = df
    for wanted, column in marks:
        if column in df.columns:
            marked = _marked(marked, wanted, column)
    return marked.where("not _hit").select(*df.columns) if "_hit" in marked.columns else df


def redact_person(tables: dict[str, DataFrame], request: DataFrame) -> dict[str, DataFrame]:
    """Forget persons in all tables that know them.

    ``request``: ``tenant_id, key_type, key_hash`` of those who asked, and ``shopify_customer_id`` where it is known. Their
    persons are those of ``tables["identity_keys"]`` with one of these hashes, whatever its type. Orders and open checkouts
    stay, without person, customer and hashes (a hash that stays would rebuild the person); visitors and customers lose the
    link; the customers who asked, keys, persons, merges and renumbering requests go. Tables that are not given are left out.
    """
    hashes = request.select("tenant_id", F.col("key_hash").alias("value")).where("value is not null").distinct()
    keys = tables["identity_keys"]
    people = keys.join(hashes.withColumnRenamed("value", "key_hash"), ["tenant_id", "key_hash"], "left_semi").select("tenant_id", F.col("person_id").alias("value")).distinct()
    owners = [(people, "person_id")]
    contacts = [(hashes, c) for c in ("email_hash", "phone_hash", "customer_hash")]
    asked = []
    if "shopify_customer_id" in request.columns:
        asked = [(request.select("tenant_id", F.col("shopify_customer_id").alias("value")).where("value is not null").distinct(), "shopify_customer_id")]
    links = ("person_id", "shopify_customer_id", "email_hash", "phone_hash", "customer_hash")
    how = {
        "orders": lambda df: _cleared(df, [*owners, *contacts, *asked], links),
        "abandoned_checkouts": lambda df: _cleared(df, [*owners, *contacts], links),
        "visitors": lambda df: _cleared(df, owners, ("person_id",)),
        "customers": lambda df: _cleared(_without(df, asked), owners, ("person_id",)),
        "identity_keys": lambda df: _without(df, [*owners, (hashes, "key_hash")]),
        "persons": lambda df: _without(df, owners),
        "person_merges": lambda df: _without(df, [(people, "survivor_id"), (people, "absorbed_id")]),
        "resequence_queue": lambda df: _without(df, owners),
    }
    return {name: how[name](df) for name, df in tables.items()}


def orphan_events(events: DataFrame, tenants: DataFrame) -> DataFrame:
    return events.join(tenants.select("tenant_id"), "tenant_id", "left_anti")


def request_dedup(requests: DataFrame, now: datetime | str, hours: int = 24, limit: int = 50) -> DataFrame:
    """Requests once per (topic, payload digest); of those not completed, the oldest that are over ``hours`` old."""
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    first = F.row_number().over(Window.partitionBy("topic", "payload_digest").orderBy("received_at", "request_id"))
    once = requests.withColumn("payload_digest", digest).withColumn("_n", first).where("_n = 1").drop("_n")
    late = once.where(F.col("completed_at").isNull() & (F.col("received_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))
    return late.orderBy("received_at", "request_id").limit(limit)
