"""Orders to people: shared identity keys, connected components, sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.components import connected_components

# Key types in order of trust.
KEY_TYPES = (("customer", "customer_hash"), ("phone", "phone_hash"), ("email", "email_hash"))
BY_KEY = ["tenant_id", "key_type", "key_hash"]
#: Shares that the orders of one key are dealt into, so that one very common key spreads over as many tasks.
KEY_SHARES = 64


def identity_keys(orders: DataFrame) -> DataFrame:
    """Up to three typed keys per order: ``tenant_id, order_id, created_at, key_type, key_hash``."""
    keys = F.array(*(F.struct(F.lit(t).alias("key_type"), F.col(c).alias("key_hash")) for t, c in KEY_TYPES))
    return orders.select("tenant_id", "order_id", "created_at", F.inline(F.filter(keys, lambda k: k["key_hash"].isNotNull())))


def _key_edges(keys: DataFrame, node: Column) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b`` that link the orders of each key to its least one, and each key's least order as ``hub``.

    As many edges as keys, however shared a key is. An order learns of the least one through its share of the key, so no join
    brings more than a share of a key's orders together.
    """
    dealt = keys.select(*BY_KEY, node.alias("a"), F.pmod(F.xxhash64("order_id"), F.lit(KEY_SHARES)).alias("share"))
    shares = dealt.groupBy(*BY_KEY, "share").agg(F.min("a").alias("least"))
    shares = shares.withColumn("b", F.min("least").over(Window.partitionBy(*BY_KEY)))
    hubs = shares.where("least = b").select(*BY_KEY, F.col("b").alias("hub"))
    return dealt.join(shares, [*BY_KEY, "share"]).select("a", "b"), hubs


def identity_resolve(orders: DataFrame) -> DataFrame:
    """``tenant_id, order_id, person_id``: orders that share any key are one person, named by its earliest order.

    An order without keys is a person of its own.
    """
    edges, _ = _key_edges(identity_keys(orders), F.struct("tenant_id", "created_at", "order_id"))
    found = connected_components(edges).select(
        F.col("node.tenant_id").alias("tenant_id"), F.col("node.order_id").alias("order_id"), F.col("component.order_id").alias("_person")
    )
    joined = orders.select("tenant_id", "order_id").join(found, ["tenant_id", "order_id"], "left")
    return joined.select("tenant_id", "order_id", F.coalesce("_person", "order_id").alias("person_id"))


def identity_keyless(orders: DataFrame) -> DataFrame:
    """Orders without any key, each a person of its own."""
    none = F.coalesce(*(F.col(c) for _, c in KEY_TYPES)).isNull()
    return orders.where(none).select("tenant_id", "order_id", F.col("order_id").alias("person_id"))


def identity_incremental(stored: DataFrame, new_orders: DataFrame) -> DataFrame:
    """Persons of new orders, given ``stored`` keys (``tenant_id, key_type, key_hash, person_id``).

    A new order joins the persons of its keys and merges those it bridges; the least person id survives. Returns
    ``tenant_id, node_kind ('order' or 'person'), node_id, person_id`` for new orders and for touched stored persons.
    """
    keys = identity_keys(new_orders)
    # stored persons sort before new orders, so that a component is named by a stored person if it has one
    person = F.struct(F.col("tenant_id"), F.lit(0).alias("rank"), F.col("person_id").alias("id"))
    order = F.struct(F.col("tenant_id"), F.lit(1).alias("rank"), F.col("order_id").alias("id"))
    among, hubs = _key_edges(keys, order)
    # a key's orders hang together, so one of them leads to its stored persons
    to_stored = hubs.join(stored, BY_KEY).select(F.col("hub").alias("a"), person.alias("b"))
    found = connected_components(to_stored.unionByName(among))
    rows = found.select(
        F.col("node.tenant_id").alias("tenant_id"), F.when(F.col("node.rank") == 0, "person").otherwise("order").alias("node_kind"),
        F.col("node.id").alias("node_id"), F.col("component.id").alias("person_id"),
    )
    alone = identity_keyless(new_orders).select("tenant_id", F.lit("order").alias("node_kind"), F.col("order_id").alias("node_id"), "person_id")
    return rows.unionByName(alone)


def identity_merges(stored: DataFrame, incremental: DataFrame, new_orders: DataFrame) -> DataFrame:
    """``tenant_id, survivor_id, absorbed_id, key_type``: persons that lost their id, and the most trusted new key of theirs."""
    moved = incremental.where("node_kind = 'person' and node_id <> person_id").select("tenant_id", F.col("node_id").alias("absorbed_id"), F.col("person_id").alias("survivor_id"))
    touched = identity_keys(new_orders).select(*BY_KEY).distinct()
    rank = F.array_position(F.lit([t for t, _ in KEY_TYPES]), F.col("key_type"))
    keys = stored.join(touched, BY_KEY).groupBy("tenant_id", F.col("person_id").alias("absorbed_id")).agg(F.min_by("key_type", rank).alias("key_type"))
    return moved.join(keys, ["tenant_id", "absorbed_id"], "left").select("tenant_id", "survivor_id", "absorbed_id", "key_type")


def persons(orders: DataFrame) -> DataFrame:
    """``tenant_id, person_id, first_seen_at, last_seen_at, orders``."""
    known = orders.where("person_id is not null")
    return known.groupBy("tenant_id", "person_id").agg(
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.count("*").alias("orders")
    )


def order_sequence(orders: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add ``order_sequence``: a person's qualifying orders numbered by (created_at, order_id).

    Cancelled orders never qualify; refunded ones only where the tenant counts them. A person's orders are numbered inside
    hours and the hours' counts added up, so a person of millions of orders spreads over tasks; orders that do not qualify
    are spread by their id.
    """
    policy = tenants.select("tenant_id", F.coalesce("refunded_counts_as_order", F.lit(True)).alias("_counts"))
    refunded = F.coalesce(F.upper("financial_status"), F.lit("")) == "REFUNDED"
    fits = F.col("cancelled_at").isNull() & F.col("person_id").isNotNull() & (F.coalesce("_counts", F.lit(True)) | ~refunded)
    # an order without a time comes first
    hour = F.coalesce(F.floor(F.unix_timestamp("created_at") / 3600), F.lit(-(1 << 62)))
    slot = F.when(F.col("_fits"), hour).otherwise(F.xxhash64("order_id"))
    base = orders.drop("order_sequence").join(policy, "tenant_id", "left").withColumn("_fits", fits).withColumn("_slot", slot)
    hours = base.where("_fits").groupBy("tenant_id", "person_id", "_slot").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("tenant_id", "person_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("tenant_id", "person_id", "_slot", F.lit(True).alias("_fits"), ahead.alias("_ahead")).where("_ahead > 0").alias("h")
    place = ("tenant_id", "person_id", "_fits", "_slot")
    joined = base.alias("o").join(hours, reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}")) for c in place]), "left")
    inside = F.row_number().over(Window.partitionBy(*(f"o.{c}" for c in place)).orderBy("created_at", "order_id"))
    number = F.when(F.col("o._fits"), (inside + F.coalesce("_ahead", F.lit(0))).cast("int"))
    return joined.select("o.*", number.alias("order_sequence")).drop("_fits", "_counts", "_slot")


def visitor_person_link(visitors: DataFrame, orders: DataFrame) -> DataFrame:
    """Visitors with the person of their first order, unless they have one already."""
    claims = orders.where("visitor_key is not null and person_id is not null").groupBy("tenant_id", "visitor_key").agg(
        F.min_by("person_id", F.struct("created_at", "order_id")).alias("_new")
    )
    joined = visitors.join(claims, ["tenant_id", "visitor_key"], "left")
    return joined.withColumn("person_id", F.coalesce("person_id", "_new")).drop("_new")
