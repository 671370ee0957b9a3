import random
from datetime import datetime, timedelta

import pytest

from tallyloom.operators import attribution as at

NOW = datetime(2024, 6, 10, 12)
RULES = "tenant_id INT, priority INT, match_field STRING, match_op STRING, match_value STRING, channel STRING, enabled BOOLEAN"


@pytest.fixture(scope="module")
def dims(spark):
    tags = [(1, 1, "instagram", None, None, False, False), (1, 2, "klaviyo", None, None, False, False), (1, 3, None, None, None, True, False), (1, 4, None, None, None, False, True), (1, 5, "google", "cpc", None, False, False), (1, 6, "blog", None, None, False, False)]
    campaigns = spark.createDataFrame(tags, "tenant_id INT, campaign_id BIGINT, utm_source STRING, utm_medium STRING, utm_campaign STRING, has_gclid BOOLEAN, has_fbclid BOOLEAN")
    hosts = spark.createDataFrame([(1, 1, "www.google.com"), (1, 2, "unknown.example")], "tenant_id INT, referrer_id BIGINT, referrer_host STRING")
    paths = spark.createDataFrame([(1, 1, "/sale/now")], "tenant_id INT, path_id BIGINT, path STRING")
    return campaigns, hosts, paths


def channels(spark, dims, rules, triples):
    df = spark.createDataFrame([(1, *t) for t in triples], "tenant_id INT, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    got = at.channel_classify(df, rules, *dims).collect()
    return {(r["campaign_id"], r["referrer_id"], r["path_id"]): r["channel"] for r in got}


def test_default_rules(spark, dims):
    got = channels(spark, dims, at.default_rules(spark, 1), [(1, None, None), (3, None, None), (4, None, None), (5, None, None), (None, 1, None), (None, 2, None), (6, None, None), (None, None, None)])
    assert list(got[k, None, None] for k in (1, 3, 4, 5, 6, None)) == ["Instagram", "Google Ads", "Facebook", "Google Ads", "Other", "Direct/Untracked"]
    # the empty-source rule takes an unknown referrer too
    assert (got[None, 1, None], got[None, 2, None]) == ("Organic Search", "Direct/Untracked")


def test_operators_and_bad_regex(spark, dims):
    rows = [(1, 1, "landing_path", "regex", "([", "Broken", True), (1, 2, "landing_path", "regex", "^/SALE", "Sale", True), (1, 3, "utm_source", "exists", None, "Tagged", True), (1, 0, "utm_source", "exists", None, "Off", False)]
    got = channels(spark, dims, spark.createDataFrame(rows, RULES), [(None, None, 1), (6, None, None), (None, 2, None), (None, None, None)])
    assert got == {(None, None, 1): "Sale", (6, None, None): "Tagged", (None, 2, None): "Other", (None, None, None): "Direct/Untracked"}


def test_first_last_and_pending(spark, dims):
    orders = spark.createDataFrame(
        [(1, 4001, 1, None, NOW - timedelta(days=1)), (1, 4002, 2, None, NOW - timedelta(days=1)), (1, 4003, 3, None, NOW - timedelta(days=1)), (1, 4004, 40, 9, NOW - timedelta(days=1)), (1, 4005, 5, None, NOW - timedelta(days=1)), (1, 4007, 7, None, NOW - timedelta(hours=1))],
        "tenant_id INT, order_id BIGINT, visitor_key BIGINT, person_id BIGINT, created_at TIMESTAMP",
    )
    visitors = spark.createDataFrame([(1, 41, 9)], "tenant_id INT, visitor_key BIGINT, person_id BIGINT")
    ago = lambda d: NOW - timedelta(days=d)
    touches = [(1, 1, ago(5), 1, None), (2, 2, ago(9), 1, None), (3, 2, ago(2), 2, None), (4, 3, ago(45), 1, None), (5, 41, ago(3), 1, None), (6, 1, ago(0), 2, None), (7, 2, ago(31), 5, None)]
    events = spark.createDataFrame([(1, u, v, t, c, r, None) for u, v, t, c, r in touches], "tenant_id INT, event_uid BIGINT, visitor_key BIGINT, occurred_at TIMESTAMP, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    wanted = at.attr_visitor_set(orders, visitors)
    rows = at.attr_pixel_first_last(orders, wanted, at.attr_touches(events, wanted))
    filled = at.channel_backfill(rows.selectExpr("*", "cast(null as string) as channel"), at.default_rules(spark, 1), *dims).collect()
    got = {(r["order_id"], r["model"]): (r["campaign_id"], r["channel"], r["touch_at"]) for r in filled}
    assert got[4001, "pixel_last"][:2] == (1, "Instagram")
    # 31 days before now is exactly 30 days before the order: still inside
    assert (got[4002, "pixel_first"][1], got[4002, "pixel_last"][1]) == ("Google Ads", "Email")
    assert got[4003, "pixel_last"] == (None, "Direct/Untracked", None)
    assert got[4004, "pixel_last"][1] == "Instagram"
    stored = rows.where("order_id <> 4007")
    assert [r["order_id"] for r in at.attr_pending(orders, stored, NOW).collect()] == [4003, 4005]


def test_own_hosts_can_be_left_out(spark):
    e = spark.createDataFrame([(1, 1, 1, NOW, None, 8, None), (1, 2, 1, NOW, 3, 8, None)], "tenant_id INT, event_uid BIGINT, visitor_key BIGINT, occurred_at TIMESTAMP, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    wanted = e.select("tenant_id", "visitor_key")
    own = spark.createDataFrame([(1, 8)], "tenant_id INT, referrer_id BIGINT")
    assert at.attr_touches(e, wanted).count() == 2
    assert [r["event_uid"] for r in at.attr_touches(e, wanted, own).collect()] == [2]


def test_hot_visitor(spark):
    """All orders and touches of one visitor: rows out stay two an order."""
    orders = spark.range(300).selectExpr("1 as tenant_id", "id as order_id", "0L as visitor_key", "cast(null as bigint) as person_id", "timestamp'2024-06-01' + make_interval(0,0,0,0,0,cast(id as int)) as created_at")
    events = spark.range(500).selectExpr("1 as tenant_id", "id as event_uid", "0L as visitor_key", "timestamp'2024-05-31' + make_interval(0,0,0,0,0,cast(id * 4 as int)) as occurred_at", "id as campaign_id", "cast(null as bigint) as referrer_id", "cast(null as bigint) as path_id")
    wanted = at.attr_visitor_set(orders, spark.createDataFrame([], "tenant_id INT, visitor_key BIGINT, person_id BIGINT"))
    rows = at.attr_pixel_first_last(orders, wanted, events).where("model = 'pixel_last'").collect()
    assert len(rows) == 300
    assert all(r["campaign_id"] == (24 * 60 + r["order_id"]) // 4 for r in rows)


def test_first_and_last_against_a_loop(spark):
    """Few visitors, many touches and orders, ties in time: as by looking at every pair."""

    rng = random.Random(9)
    at0 = datetime(2024, 5, 1)
    touches = [(1, i, rng.randrange(4), at0 + timedelta(seconds=rng.randrange(0, 60 * 86_400, 1800)), i, None, None) for i in range(800)]
    placed = [(1, 9000 + i, at0 + timedelta(seconds=rng.randrange(0, 70 * 86_400, 900)), rng.randrange(5)) for i in range(300)]
    placed += [(1, 9000, at0, 2)]  # an order with two visitors
    events = spark.createDataFrame(touches, "tenant_id INT, event_uid BIGINT, visitor_key BIGINT, occurred_at TIMESTAMP, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    wanted = spark.createDataFrame(placed, "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, visitor_key BIGINT")
    orders = wanted.select("tenant_id", "order_id").distinct()
    got = {(r["order_id"], r["model"]): r["campaign_id"] for r in at.attr_pixel_first_last(orders, wanted, events).collect()}
    for order in {p[1] for p in placed}:
        mine = [(t[3], t[1]) for p in placed if p[1] == order for t in touches if t[2] == p[3] and p[2] - timedelta(days=30) <= t[3] <= p[2]]
        assert got[order, "pixel_first"] == (min(mine)[1] if mine else None), order
        assert got[order, "pixel_last"] == (max(mine)[1] if mine else None), order


def test_ten_thousand_tenants_with_rules_of_their_own(spark):
    triples = spark.range(1, 10_001).selectExpr("cast(id as int) as tenant_id", "1L as campaign_id", "cast(null as bigint) as referrer_id", "cast(null as bigint) as path_id")
    campaigns = spark.range(1, 10_001).selectExpr("cast(id as int) as tenant_id", "1L as campaign_id", "concat('source', id % 7) as utm_source", "cast(null as string) as utm_medium", "cast(null as string) as utm_campaign", "false as has_gclid", "false as has_fbclid")
    own = spark.range(1, 10_001).selectExpr("cast(id as int) as tenant_id", "5 as priority", "'utm_source' as match_field", "if(id % 2 = 0, 'regex', 'equals') as match_op", "if(id % 2 = 0, '^SOURCE[0-3]$', 'source1') as match_value", "concat('own', id) as channel", "true as enabled")
    rules = own.unionByName(at.channel_rules_seed(at.default_rules(spark), triples))
    assert rules.count() == 29 * 10_000
    hosts = spark.createDataFrame([], "tenant_id INT, referrer_id BIGINT, referrer_host STRING")
    paths = spark.createDataFrame([], "tenant_id INT, path_id BIGINT, path STRING")
    got = {r["tenant_id"]: r["channel"] for r in at.channel_classify(triples, rules, campaigns, hosts, paths).collect()}
    assert len(got) == 10_000
    for t in range(1, 10_001):
        hit = t % 7 <= 3 if t % 2 == 0 else t % 7 == 1
        assert got[t] == (f"own{t}" if hit else "Other")


def test_expressions_among_plain_rules(spark):
    import re

    rng = random.Random(8)
    fields = ("utm_source", "utm_medium", "landing_path")
    words = ("news", "mail", "ad", "shop", "")
    rules = [
        (t, p, rng.choice(fields), op, rng.choice(("^news", "a[id]", "s.op$", "x|mail")) if op == "regex" else rng.choice(words[:4]), f"{t}-{p}", True)
        for t in (1, 2) for p in range(12) for op in [rng.choice(("regex", "equals", "contains"))]
    ]
    campaigns = [(t, c, rng.choice(words), rng.choice(words)) for t in (1, 2, 3) for c in range(20)]
    paths = [(t, p, w) for t in (1, 2, 3) for p, w in enumerate(words)]
    rows = [(t, c, None, rng.randrange(5)) for t, c, *_ in campaigns for _ in range(3)]
    rows += rows[:10]  # repeated rows stay
    triples = spark.createDataFrame(rows, "tenant_id INT, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    tagged = spark.createDataFrame(campaigns, "tenant_id INT, campaign_id BIGINT, utm_source STRING, utm_medium STRING").selectExpr("*", "cast(null as string) as utm_campaign", "false as has_gclid", "false as has_fbclid")
    hosts = spark.createDataFrame([], "tenant_id INT, referrer_id BIGINT, referrer_host STRING")
    landed = spark.createDataFrame(paths, "tenant_id INT, path_id BIGINT, path STRING")
    got = at.channel_classify(triples, spark.createDataFrame(rules, RULES), tagged, hosts, landed).collect()
    where, tag = {(t, p): w for t, p, w in paths}, {(t, c): (s, m) for t, c, s, m in campaigns}

    def channel(t, c, p):
        facts = dict(zip(fields, (*tag[t, c], where[t, p]), strict=True))
        for rt, _, field, op, value, name, _ in rules:
            fact = facts[field]
            if rt == t and (re.search(value, fact) if op == "regex" else fact == value if op == "equals" else value in fact):
                return name
        return "Other" if any(facts.values()) else "Direct/Untracked"

    assert sorted((r["tenant_id"], r["campaign_id"], r["path_id"], r["channel"]) for r in got) == sorted((t, c, p, channel(t, c, p)) for t, c, _, p in rows)
