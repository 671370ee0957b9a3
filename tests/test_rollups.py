"""Planted stores with known answers."""

import random
from datetime import date, datetime, timedelta

import pytest

from tallyloom.operators import identity, reports, rollups

NOW = datetime(2024, 6, 10, 12)
EVENTS = "tenant_id INT, event_uid BIGINT, occurred_at TIMESTAMP, event_type INT, visitor_key BIGINT, product_id BIGINT, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT, geo_id BIGINT, ua_id BIGINT"
ORDERS = "tenant_id INT, order_id BIGINT, person_id BIGINT, visitor_key BIGINT, created_at TIMESTAMP, cancelled_at TIMESTAMP, total_minor BIGINT, refunded_minor BIGINT, financial_status STRING"


@pytest.fixture(scope="module")
def tenants(spark):
    rows = [(1, "Asia/Kolkata", True, datetime(2024, 6, 1)), (2, "Nowhere/Wrong", False, datetime(2024, 6, 1))]
    return spark.createDataFrame(rows, "tenant_id INT, iana_timezone STRING, refunded_counts_as_order BOOLEAN, installed_at TIMESTAMP")


def events(spark, rows):
    """rows: (visitor, code, UTC time[, product])."""
    full = [(1, i, r[2], r[1], r[0], r[3] if len(r) > 3 else None, None, None, None, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def orders(spark, rows, tenant=1):
    """rows: (order, person, UTC time[, status[, cancelled]])."""
    full = [(tenant, r[0], r[1], None, r[2], r[2] if len(r) > 4 and r[4] else None, 1000, 0, r[3] if len(r) > 3 else "PAID") for r in rows]
    return spark.createDataFrame(full, ORDERS)


def local(hour, minute=0, day=5):
    """A Kolkata wall-clock time of June 2024 as UTC."""
    return datetime(2024, 6, day, hour, minute) - timedelta(hours=5, minutes=30)


def test_local_day_and_sessions(spark, tenants):
    rows = [(1, 1, local(0, 30)), (9, 1, local(23, 30, day=4)), (2, 1, local(9)), (2, 1, local(12)), (3, 1, local(10)), (4, 1, local(11))]
    days = rollups.visitor_days(rollups.with_day(events(spark, rows), tenants, "occurred_at"))
    got = {r["stat_date"]: r for r in days.groupBy("stat_date").agg({"visitor_key": "count", "sessions": "sum"}).collect()}
    assert got[date(2024, 6, 5)]["count(visitor_key)"] == 4
    assert got[date(2024, 6, 5)]["sum(sessions)"] == 5
    assert got[date(2024, 6, 4)]["count(visitor_key)"] == 1


def test_session_gap_is_strict(spark, tenants):
    at = local(10)
    rows = [(1, 1, at), (1, 1, at + timedelta(minutes=30)), (1, 1, at + timedelta(minutes=60, seconds=1))]
    assert rollups.sessions_daily(rollups.with_day(events(spark, rows), tenants, "occurred_at")).first()["sessions"] == 2


def test_sessions_against_a_loop(spark, tenants):
    rng = random.Random(5)
    rows = [(rng.randrange(6), 1, datetime(2024, 6, 3) + timedelta(seconds=rng.randrange(200_000))) for _ in range(600)]
    got = {(r["stat_date"], r["visitor_key"]): r["sessions"] for r in rollups.visitor_days(rollups.with_day(events(spark, rows), tenants, "occurred_at")).collect()}
    want, last = {}, {}
    for v, _, t in sorted(rows, key=lambda r: r[2]):
        key = ((t + timedelta(hours=5, minutes=30)).date(), v)
        if key not in last or (t - last[key]).total_seconds() > 1800:
            want[key] = want.get(key, 0) + 1
        last[key] = t
    assert got == want


def test_funnel_and_checkout(spark, tenants):
    v1 = [(1, c, local(10, i)) for i, c in enumerate((1, 3, 6, 8, 12, 13))]
    v2 = [(2, c, local(11, i)) for i, c in enumerate((3, 6, 8))] + [(2, 9, local(11, 9))]
    extra = [(3, 1, local(12)), (4, 1, local(12)), (3, 3, local(11, 50))]
    e = rollups.with_day(events(spark, v1 + v2 + extra), tenants, "occurred_at")
    days = rollups.visitor_days(e)
    spine = days.select("tenant_id", "stat_date").distinct()
    steps = {r["step"]: r for r in rollups.funnel_daily(spine, days).collect()}
    assert len(steps) == 6
    assert (steps[1]["reached_visitors"], steps[2]["reached_visitors"], steps[2]["strict_visitors"], steps[6]["reached_visitors"]) == (3, 3, 1, 1)
    checkouts = spark.createDataFrame([(1, 7, date(2024, 6, 5), None, 900)], "tenant_id INT, checkout_id BIGINT, stat_date DATE, completed_at TIMESTAMP, total_minor BIGINT")
    stages = {r["stage"]: r for r in rollups.abandon_daily(spine, days, checkouts).collect()}
    assert (stages[2]["entered"], stages[2]["abandoned"]) == (2, 0)
    assert (stages[3]["abandoned"], stages[3]["shopify_records"], stages[3]["value_minor"]) == (1, 1, 900)
    assert all(s["advanced"] <= s["entered"] for s in stages.values())
    assert (stages[7]["entered"], stages[7]["abandoned"]) == (1, 0)


def test_kpi_orders_provisional_and_rerun(spark, tenants):
    placed = orders(spark, [(5000, 1, NOW - timedelta(days=40)), (5001, 1, local(10)), (5002, 2, local(11)), (5003, 2, local(12), "PAID", True)])
    sequenced = rollups.with_day(identity.order_sequence(placed, tenants), tenants, "created_at")
    lines = spark.createDataFrame([(1, 5001, 9, 2), (1, 5003, 9, 7)], "tenant_id INT, order_id BIGINT, product_id BIGINT, quantity INT")
    spine = rollups.days_from(tenants.where("tenant_id = 1"), "2024-06-01", NOW)
    visitors = rollups.visitor_days(rollups.with_day(events(spark, [(1, 1, local(9))]), tenants, "occurred_at"))
    kpi = rollups.kpi_daily(spine, visitors, sequenced, lines, tenants, NOW)
    rows = {r["stat_date"]: r for r in kpi.collect()}
    day = rows[date(2024, 6, 5)]
    assert (day["orders"], day["purchasers"], day["revenue_minor"], day["new_customers"], day["repeat_customers"], day["units"]) == (2, 2, 2000, 1, 1, 2)
    assert len(rows) == 10 and rows[date(2024, 6, 2)]["visitors"] == 0
    # now is 17:30 local on the 10th: the 7th is closed already, the 8th is not
    assert (rows[date(2024, 6, 7)]["is_provisional"], rows[date(2024, 6, 8)]["is_provisional"]) == (0, 1)
    assert sorted(map(tuple, kpi.collect())) == sorted(map(tuple, kpi.collect()))


def test_two_buyers_three_orders(spark, tenants):
    placed = orders(spark, [(1, 7, local(9)), (2, 7, local(10)), (3, 8, local(11))])
    day = rollups.day_orders(rollups.with_day(identity.order_sequence(placed, tenants), tenants, "created_at")).first()
    assert (day["orders"], day["purchasers"], day["new_customers"], day["repeat_customers"]) == (3, 2, 2, 0)


def test_refunds_and_sequence(spark, tenants):
    strict = tenants.withColumn("refunded_counts_as_order", tenants["tenant_id"] == 2)
    placed = orders(spark, [(1, 7, local(9), "REFUNDED"), (2, 7, local(10)), (3, 8, local(11), "refunded"), (4, 9, local(12), "PAID", True), (5, 9, local(13))])
    got = {r["order_id"]: r["order_sequence"] for r in identity.order_sequence(placed, strict).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: 1}
    day = rollups.day_orders(rollups.with_day(identity.order_sequence(placed.where("order_id = 3"), strict), tenants, "created_at")).first()
    assert (day["purchasers"], day["new_customers"], day["repeat_customers"]) == (1, 0, 0)


def test_product_day(spark, tenants):
    e = rollups.with_day(events(spark, [(1, 3, local(9), 100), (2, 3, local(9), 100), (1, 6, local(9), 100), (2, 6, local(9), 100)]), tenants, "occurred_at")
    placed = rollups.with_day(orders(spark, [(1, 7, local(9))]), tenants, "created_at")
    lines = spark.createDataFrame([(1, 1, 100, 2, 500, 50), (1, 1, 100, 0, 500, 0)], "tenant_id INT, order_id BIGINT, product_id BIGINT, quantity INT, price_minor BIGINT, discount_minor BIGINT")
    open_ = spark.createDataFrame([(1, 4, date(2024, 6, 5), None, 1)], "tenant_id INT, checkout_id BIGINT, stat_date DATE, completed_at TIMESTAMP, total_minor BIGINT")
    items = spark.createDataFrame([(1, 4, 100), (1, 4, 100)], "tenant_id INT, checkout_id BIGINT, product_id BIGINT")
    row = rollups.product_daily(e, placed, lines, open_, items).first()
    assert (row["views"], row["viewers"], row["atc"], row["purchases"], row["units"], row["revenue_minor"], row["abandons"]) == (2, 2, 2, 1, 2, 950, 1)


def test_cohort_buckets(spark, tenants):
    at = datetime(2024, 1, 10)
    placed = identity.order_sequence(orders(spark, [(1, 7, at), (2, 7, at + timedelta(days=40))]), tenants)
    got = {r["days_bucket"]: r["reordered"] for r in rollups.cohort_repeat(placed).collect()}
    assert got == {30: 0, 60: 1, 90: 1, 180: 1}


def test_range_buyers(spark, tenants):
    ago = lambda d: NOW - timedelta(days=d)
    placed = orders(spark, [(1, 1, ago(24)), (2, 1, ago(18)), (3, 2, ago(60)), (4, 2, ago(22)), (5, 2, ago(10)), (6, 3, ago(15))])
    today = NOW.date()
    row = reports.range_buyers(identity.order_sequence(placed, tenants), tenants, today - timedelta(days=25), today - timedelta(days=5)).first()
    assert (row["buyers"], row["new_buyers"], row["returning_buyers"], row["rate"]) == (3, 2, 1, 33.3)


def test_day_spine_and_bad_zone(spark, tenants):
    closed = spark.createDataFrame([(1, date(2024, 6, 7), 0), (1, date(2024, 6, 8), 1)], "tenant_id INT, stat_date DATE, is_provisional INT")
    placed = orders(spark, [(1, 1, datetime(2024, 5, 30))], tenant=2)
    days = rollups.day_spine(tenants, placed, closed, NOW).collect()
    assert [r["stat_date"].day for r in days if r["tenant_id"] == 1] == [8, 9, 10]
    mine = [r["stat_date"] for r in days if r["tenant_id"] == 2]
    assert mine[0] == date(2024, 5, 30) and len(mine) == 10


def test_report_range():
    today = date(2024, 6, 10)
    assert reports.report_range(None, None, today) == (date(2024, 5, 12), today, date(2024, 4, 12), date(2024, 5, 11))
    assert reports.report_range(today, date(2024, 6, 1), today)[:2] == (date(2024, 6, 1), today)
    assert reports.report_range(date(2010, 1, 1), today, today)[0] == today - timedelta(days=800)


def test_dst_days(spark):
    zone = spark.createDataFrame([(1, "Europe/Berlin")], "tenant_id INT, iana_timezone STRING")
    rows = [(1, 1, datetime(2024, 3, 30, 23, 30)), (1, 1, datetime(2024, 3, 31, 21, 59)), (1, 1, datetime(2024, 3, 31, 22, 0))]
    got = [r["stat_date"].day for r in rollups.with_day(events(spark, rows), zone, "occurred_at").orderBy("event_uid").collect()]
    assert got == [31, 31, 1]


def test_one_visitor_with_very_many_events(spark, tenants):
    """All anonymous events share a visitor: what is put in order is half hours, not events."""
    e = spark.range(200_000).selectExpr("1 as tenant_id", "id as event_uid", "timestamp'2024-06-03 00:00:00' + make_interval(0,0,0,0,0,0,cast(id % 86400 as int)) as occurred_at", "1 as event_type", "0L as visitor_key")
    e = rollups.with_day(e.where("second(occurred_at) = 0 and minute(occurred_at) in (0, 31)"), tenants, "occurred_at")
    slots = rollups.session_slots(e, *rollups.DAY, "visitor_key")
    assert slots.count() == 48
    # pauses of 31 and 29 minutes by turns; both days begin with the second half of a pair
    assert {str(r["stat_date"]): r["sessions"] for r in rollups.sessions_daily(e).collect()} == {"2024-06-03": 19, "2024-06-04": 6}


def test_more_tenants_than_a_driver_lists(spark):
    stores = spark.range(150_000).selectExpr("cast(id as int) as tenant_id", "if(id % 2 = 0, 'Asia/Kolkata', 'No/Where') as iana_timezone")
    e = stores.selectExpr("tenant_id", "timestamp'2024-06-03 20:00:00' as occurred_at")
    days = rollups.with_day(e, stores, "occurred_at").groupBy("stat_date").count().collect()
    assert {(str(r["stat_date"]), r["count"]) for r in days} == {("2024-06-04", 75_000), ("2024-06-03", 75_000)}
