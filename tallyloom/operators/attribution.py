"""Touches, attribution models and channels."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.small import small_table
from tallyloom.plans.lineage import cut_lineage
from tallyloom.schemas import DEFAULT_RULES, DIRECT, GRACE_HOURS, LOOKBACK_DAYS, OTHER, RECLOSE_DAYS

FACTS = ("utm_source", "utm_medium", "utm_campaign", "referrer_host", "landing_path", "has_gclid", "has_fbclid")
TRIPLE = ("tenant_id", "campaign_id", "referrer_id", "path_id")
#: Touches of a visitor are put in order inside hours, and hours among each other.
SLOT_SECONDS = 3600


def attr_pending(orders: DataFrame, attribution: DataFrame, now: datetime | str, limit: int | None = 500) -> DataFrame:
    """Orders past the grace time with no pixel touch row, or still young with a campaign-less one; oldest first (all without ``limit``)."""
    at = F.lit(now).cast("timestamp")
    last = attribution.where("model = 'pixel_last'").select("tenant_id", "order_id", F.col("campaign_id").alias("_c"), F.lit(True).alias("_has"))
    joined = orders.join(last, ["tenant_id", "order_id"], "left")
    fresh = F.col("created_at") > at - F.expr(f"INTERVAL {RECLOSE_DAYS} DAYS")
    due = (F.col("created_at") < at - F.expr(f"INTERVAL {GRACE_HOURS} HOURS")) & (F.col("_has").isNull() | (F.col("_c").isNull() & fresh))
    found = joined.where(due).select("tenant_id", "order_id", "created_at", "visitor_key", "person_id")
    return found if limit is None else found.orderBy("created_at", "order_id").limit(limit)


def attr_visitor_set(orders: DataFrame, visitors: DataFrame) -> DataFrame:
    """``tenant_id, order_id, created_at, visitor_key``: an order's own visitor and all of its person."""
    own = orders.where("visitor_key is not null").select("tenant_id", "order_id", "created_at", "visitor_key")
    linked = visitors.where("person_id is not null").select("tenant_id", "person_id", "visitor_key")
    others = orders.where("person_id is not null").select("tenant_id", "order_id", "created_at", "person_id").join(linked, ["tenant_id", "person_id"])
    return own.unionByName(others.select(own.columns)).distinct()


def touch_window(orders: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> tuple[datetime, datetime] | None:
    """From when to when touches of these orders can lie; None without orders."""
    first, last = orders.agg(F.min("created_at") - F.expr(f"INTERVAL {lookback_days} DAYS"), F.max("created_at")).first()
    return None if first is None else (first, last)


def attr_touches(events: DataFrame, visitor_set: DataFrame, own_hosts: DataFrame | None = None, window: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Events with a campaign or a referrer, of visitors that matter.

    ``own_hosts`` (``tenant_id, referrer_id``) leaves self-referrals out; by default they count. With a ``window`` (see
    ``touch_window``) only its days are read of a table with ``event_date`` partitions.
    """
    touches = events.where("campaign_id is not null or referrer_id is not null")
    if window is not None:
        touches = touches.where(F.col("occurred_at").between(*map(F.lit, window)))
        if "event_date" in events.columns:
            touches = touches.where(F.col("event_date").between(*(F.lit(t.date()) for t in window)))
    if own_hosts is not None:
        own = own_hosts.select("tenant_id", "referrer_id", F.lit(True).alias("_own"))
        touches = touches.join(own, ["tenant_id", "referrer_id"], "left").where("campaign_id is not null or _own is null").drop("_own")
    wanted = visitor_set.select("tenant_id", "visitor_key").distinct()
    columns = ["tenant_id", "visitor_key", "occurred_at", "event_uid", "campaign_id", "referrer_id", "path_id"]
    return touches.join(wanted, ["tenant_id", "visitor_key"], "left_semi").select(columns)


def attr_pixel_first_last(orders: DataFrame, visitor_set: DataFrame, touches: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Two rows per order, with or without a touch: the first and last in the lookback, both ends included.

    Orders are not paired with touches. The last touch is the latest up to the order's time, the first one the earliest from
    the begin of its lookback on; each is looked up as a point on the visitor's time line: inside the point's hour in time
    order, else in the nearest hour before or after that has touches. A visitor's rows spread over as many tasks as hours,
    and only one row an hour is put in order as a whole. Ties are broken by event_uid.
    """
    keys = ["tenant_id", "visitor_key"]
    touch = F.struct("occurred_at", "event_uid", "campaign_id", "referrer_id", "path_id").alias("touch")
    nothing = lambda t: F.lit(None).cast(t)
    back = F.expr(f"INTERVAL {lookback_days} DAYS")
    ends = F.inline(F.array(
        F.struct(F.lit(0).alias("is_last"), (F.col("created_at") - back).alias("at"), F.col("created_at").alias("other")),
        F.struct(F.lit(1).alias("is_last"), F.col("created_at").alias("at"), (F.col("created_at") - back).alias("other")),
    ))
    points = visitor_set.select(*keys, "order_id", ends)
    seen = touches.select(*keys, nothing(visitor_set.schema["order_id"].dataType).alias("order_id"), nothing("int").alias("is_last"), F.col("occurred_at").alias("at"), nothing("timestamp").alias("other"), touch)
    line = seen.unionByName(points.withColumn("touch", nothing(seen.schema["touch"].dataType)))
    line = line.withColumn("slot", F.floor(F.col("at").cast("long") / SLOT_SECONDS)).withColumn("is_point", F.col("is_last").isNotNull())

    slots = line.groupBy(*keys, "slot").agg(F.min("touch").alias("earliest"), F.max("touch").alias("latest"))
    in_order = Window.partitionBy(*keys).orderBy("slot")
    slots = slots.select(
        *keys, "slot",
        F.max("latest").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("earliest").over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    inside = Window.partitionBy(*keys, "slot")
    so_far = Window.unboundedPreceding, Window.currentRow
    up_to = F.max("touch").over(inside.orderBy("at", "is_point").rowsBetween(*so_far))
    since = F.min("touch").over(inside.orderBy(F.desc("at"), "is_point").rowsBetween(*so_far))
    placed = line.withColumns({"up_to": up_to, "since": since}).where("is_point").join(slots, [*keys, "slot"])
    last = F.when(F.col("is_last") == 1, F.coalesce("up_to", "before"))
    first = F.when(F.col("is_last") == 0, F.coalesce("since", "after"))
    ends = placed.select(
        "tenant_id", "order_id",
        F.when(first["occurred_at"] <= F.col("other"), first).alias("first"), F.when(last["occurred_at"] >= F.col("other"), last).alias("last"),
    ).groupBy("tenant_id", "order_id").agg(F.min("first").alias("pixel_first"), F.max("last").alias("pixel_last"))
    joined = orders.select("tenant_id", "order_id").join(ends, ["tenant_id", "order_id"], "left")
    rows = F.array(*(
        F.struct(
            F.lit(m).alias("model"), F.col(f"{m}.campaign_id").alias("campaign_id"), F.col(f"{m}.referrer_id").alias("referrer_id"),
            F.col(f"{m}.path_id").alias("landing_path_id"), F.col(f"{m}.occurred_at").alias("touch_at"),
        ) for m in ("pixel_first", "pixel_last")
    ))
    return joined.select("tenant_id", "order_id", F.inline(rows))


def attr_resolve_due(orders: DataFrame, attribution: DataFrame, events: DataFrame, visitors: DataFrame, now: datetime | str, limit: int | None = None) -> DataFrame:
    """``attribution`` with the two pixel rows of each order that is due, found again from the events of its window only.

    The due orders are few beside all; their window is what the scan of ``events`` is cut to, and no other order's rows change.
    """
    due = cut_lineage(attr_pending(orders, attribution, now, limit))
    window = touch_window(due)
    if window is None:
        return attribution
    whose = attr_visitor_set(due, visitors)
    fresh = attr_pixel_first_last(due, whose, attr_touches(events, whose, window=window))
    kept = attribution.join(fresh.select("tenant_id", "order_id", "model"), ["tenant_id", "order_id", "model"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).select(*attribution.columns)


def default_rules(spark, tenant_id: int = 0) -> DataFrame:
    return small_table(
        spark,
        [(tenant_id, *r, True) for r in DEFAULT_RULES],
        "tenant_id INT, priority INT, match_field STRING, match_op STRING, match_value STRING, channel STRING, enabled BOOLEAN",
    )


def _usable(rules: DataFrame) -> DataFrame:
    """``tenant_id, _rules``: each tenant's enabled rules that can match at all, by priority, as far as people have typed them.

    A regular expression that is none never matches.
    """
    flag, value = F.col("match_field").startswith("has_"), F.coalesce("match_value", F.lit(""))
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), F.col("match_value"), F.lit("")).isNotNull()
    fits = (
        F.when(F.col("match_op") == "exists", True).when(flag, False).when(F.col("match_op") == "equals", True)
        .when(F.col("match_op") == "contains", value != "").when(F.col("match_op") == "regex", compiles).otherwise(False)
    )
    pattern = F.when(F.col("match_op") == "regex", F.concat(F.lit("(?i)"), value)).otherwise(F.lower(value))
    rule = F.struct("priority", F.col("match_field").alias("field"), F.col("match_op").alias("op"), pattern.alias("value"), "channel")
    kept = rules.where(F.col("enabled") & F.col("match_field").isin(*FACTS) & fits)
    return kept.groupBy("tenant_id").agg(F.sort_array(F.collect_list(rule)).alias("_rules"))


def _matches(rule: Column) -> Column:
    """Whether a rule that is no regular expression matches a row with ``_facts``: lower-case texts, and a flag that is set as some text."""
    fact, value = F.element_at("_facts", rule["field"]), rule["value"]
    return F.when(rule["op"] == "exists", fact != "").when(rule["op"] == "equals", fact == value).when(rule["op"] == "contains", fact.contains(value)).otherwise(False)


def channel_classify(triples: DataFrame, rules: DataFrame, campaigns: DataFrame, referrers: DataFrame, paths: DataFrame) -> DataFrame:
    """Add ``channel`` to ``tenant_id, campaign_id, referrer_id, path_id``; give it distinct triples, not events.

    The first matching rule of the row's tenant wins. Rules meet their tenant's rows by an equi-join, one row a tenant, so
    any number of tenants may have rules of their own. Regular expressions (which see the lower-case text under ``(?i)``) are
    tried only where no plain rule comes before them, and sorted, so that a task compiles each of its expressions once.
    """
    facts = (
        triples.join(campaigns.select("tenant_id", "campaign_id", *FACTS[:3], "has_gclid", "has_fbclid"), ["tenant_id", "campaign_id"], "left")
        .join(referrers.select("tenant_id", "referrer_id", "referrer_host"), ["tenant_id", "referrer_id"], "left")
        .join(paths.select("tenant_id", "path_id", F.col("path").alias("landing_path")), ["tenant_id", "path_id"], "left")
    )
    texts = [F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FACTS[:5]]
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in FACTS[5:]]
    plain = facts.select(*triples.columns, *texts, *flags)
    entries = [x for f in FACTS for x in (F.lit(f), F.when(F.col(f), "set").otherwise("") if f.startswith("has_") else F.col(f))]
    anything = reduce(lambda a, b: a | b, [*(F.col(f) != "" for f in FACTS[:5]), *(F.col(f) for f in FACTS[5:])])
    ruled = plain.withColumn("_facts", F.create_map(*entries)).join(_usable(rules), "tenant_id", "left")
    # rules are in order, so the least one wins
    plain_hit = F.get(F.filter("_rules", _matches), F.lit(0))
    ruled = ruled.withColumn("_hit", plain_hit)
    tried = F.filter("_rules", lambda r: (r["op"] == "regex") & (F.col("_hit").isNull() | (r < F.col("_hit"))))
    tried = F.concat(F.array("_hit"), F.coalesce(tried, F.array().cast(ruled.schema["_rules"].dataType)))
    fallback = F.when(anything, OTHER).otherwise(DIRECT).alias("_fallback")
    tests = ruled.select(*triples.columns, fallback, "_facts", F.posexplode(tried).alias("_test", "_rule"))
    tests = tests.withColumn("_fact", F.element_at("_facts", F.col("_rule.field"))).drop("_facts").sortWithinPartitions("_rule.value")
    # regexp_instr keeps the last expression that it compiled, rlike keeps none
    holds = F.when(F.col("_test") == 0, F.col("_rule").isNotNull()).otherwise(F.regexp_instr("_fact", "_rule.value") > 0)
    won = F.min_by(F.col("_rule.channel"), F.when(holds, F.col("_rule")))
    # each row has one test 0, so that repeated rows stay
    judged = tests.groupBy(*triples.columns, "_fallback").agg(won.alias("_won"), F.count_if(F.col("_test") == 0).cast("int").alias("_n"))
    channel = F.explode(F.array_repeat(F.coalesce("_won", "_fallback"), F.col("_n")))
    return judged.select(*triples.columns, channel.alias("channel"))


def _with_channel(attribution: DataFrame, rules, campaigns, referrers, paths) -> DataFrame:
    """Add ``_now``, the channel under ``rules``, by classifying distinct triples."""
    rows = attribution.withColumn("path_id", F.col("landing_path_id"))
    named = channel_classify(rows.select(*TRIPLE).distinct(), rules, campaigns, referrers, paths)
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in TRIPLE]
    joined = rows.alias("a").join(named.alias("n"), reduce(lambda x, y: x & y, keys))
    return joined.select(*(F.col(f"a.{c}") for c in attribution.columns), F.col("n.channel").alias("_now"))


def channel_backfill(attribution: DataFrame, rules, campaigns, referrers, paths) -> DataFrame:
    """Channels where there are none; others stay."""
    full = _with_channel(attribution, rules, campaigns, referrers, paths)
    return full.withColumn("channel", F.coalesce("channel", "_now")).drop("_now")


def channel_reclassify(attribution: DataFrame, rules, campaigns, referrers, paths) -> DataFrame:
    """All channels under the current rules, with ``changed``."""
    full = _with_channel(attribution, rules, campaigns, referrers, paths)
    return full.withColumn("changed", ~F.col("channel").eqNullSafe(F.col("_now"))).withColumn("channel", F.col("_now")).drop("_now")


def channel_preview(attribution: DataFrame, proposed, campaigns, referrers, paths) -> DataFrame:
    """What proposed rules would move: ``from_channel, to_channel, moved``, most first; nothing is stored."""
    full = _with_channel(attribution, proposed, campaigns, referrers, paths)
    moved = full.where(~F.col("channel").eqNullSafe(F.col("_now")))
    names = [F.coalesce("channel", F.lit(DIRECT)).alias("from_channel"), F.col("_now").alias("to_channel")]
    return moved.groupBy("tenant_id", *names).agg(F.count("*").alias("moved")).orderBy(F.desc("moved"), "from_channel", "to_channel")


def channel_rules_seed(rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """The default rules (tenant 0) that tenants still lack, by priority."""
    defaults = rules.where("tenant_id = 0").drop("tenant_id")
    wanted = tenants.select("tenant_id").where("tenant_id <> 0").join(F.broadcast(defaults))
    return wanted.join(rules.select("tenant_id", "priority"), ["tenant_id", "priority"], "left_anti").select(*rules.columns)


def channel_rename(channel_rows: DataFrame, old: str, new: str) -> DataFrame:
    """A daily channel rollup with ``old`` folded into ``new``."""
    name = F.when(F.col("channel") == old, new).otherwise(F.col("channel")).alias("channel")
    sums = [F.sum(c).alias(c) for c in ("visitors", "orders", "revenue_minor")]
    return channel_rows.groupBy("tenant_id", "stat_date", "model", name).agg(*sums)


def attr_disagreement(orders: DataFrame, attribution: DataFrame, start: str, end: str) -> DataFrame:
    """How far the last pixel touch and the platform's agree on the orders of a time range."""
    from tallyloom.functions.exprs import percent

    last = lambda m, n: attribution.where(F.col("model") == m).select("tenant_id", "order_id", F.col("channel").alias(n))
    joined = orders.where((F.col("created_at") >= start) & (F.col("created_at") < end)).select("tenant_id", "order_id")
    joined = joined.join(last("pixel_last", "p"), ["tenant_id", "order_id"], "left").join(last("shopify_last", "s"), ["tenant_id", "order_id"], "left")
    p, s = F.col("p"), F.col("s")
    blind = lambda c: F.count_if(c.isNull() | (c == DIRECT))
    return joined.groupBy("tenant_id").agg(
        F.count("*").alias("orders"), F.count_if(p.isNotNull() & s.isNotNull()).alias("comparable"), F.count_if(F.coalesce(p == s, F.lit(False))).alias("agree"),
        blind(p).alias("pixel_blind"), blind(s).alias("shopify_blind"),
    ).withColumn("agree_pct", percent("agree", "comparable"))
