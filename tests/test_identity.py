import random
from datetime import datetime, timedelta

from tallyloom.operators import identity
from tallyloom.operators.components import connected_components

SCHEMA = "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, customer_hash STRING, phone_hash STRING, email_hash STRING"
AT = datetime(2024, 1, 1)


def orders(spark, rows, tenant=1):
    return spark.createDataFrame([(tenant, o, AT + timedelta(minutes=i), c, p, e) for i, (o, c, p, e) in enumerate(rows)], SCHEMA)


def people(df):
    return {r["order_id"]: r["person_id"] for r in df.collect()}


def test_shared_keys_chain(spark):
    rows = [(1001, None, "A", None), (1002, None, "A", "x"), (1003, None, None, "x"), (1004, None, "B", None)]
    got = people(identity.identity_resolve(orders(spark, rows)))
    assert got == {1001: 1001, 1002: 1001, 1003: 1001, 1004: 1004}


def test_keyless_is_alone_and_tenants_are_apart(spark):
    both = orders(spark, [(1, None, "A", "x"), (2, None, None, None)]).union(orders(spark, [(3, None, "A", "x")], tenant=2))
    assert people(identity.identity_resolve(both)) == {1: 1, 2: 2, 3: 3}


def test_deferred_merge(spark):
    old = orders(spark, [(2001, None, None, "x"), (2002, None, "A", None)])
    keys = identity.identity_keys(old).join(identity.identity_resolve(old), ["tenant_id", "order_id"])
    stored = keys.select("tenant_id", "key_type", "key_hash", "person_id")
    fresh = orders(spark, [(2003, None, "A", "x"), (2004, None, None, None)])
    got = identity.identity_incremental(stored, fresh)
    assert {(r["node_kind"], r["node_id"]): r["person_id"] for r in got.collect()} == {("person", 2001): 2001, ("person", 2002): 2001, ("order", 2003): 2001, ("order", 2004): 2004}
    merge = identity.identity_merges(stored, got, fresh).collect()
    assert [(m["survivor_id"], m["absorbed_id"], m["key_type"]) for m in merge] == [(2001, 2002, "phone")]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: find(x) for x in parent}


def test_heavy_hubs_take_the_broadcast_path(spark, monkeypatch):
    from tallyloom.operators import components

    monkeypatch.setattr(components, "HEAVY", 5)
    pairs = [(i, 50) for i in range(40)] + [(50, 90), (90, 91)] + [(200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: 200 if x >= 200 else 0 for p in pairs for x in p}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT")).collect() == []


def test_visitor_keeps_its_person(spark):
    seen = spark.createDataFrame([(1, 5, 77), (1, 6, None), (1, 7, None)], "tenant_id INT, visitor_key BIGINT, person_id BIGINT")
    placed = spark.createDataFrame([(1, 2, 6, 9, AT + timedelta(1)), (1, 1, 6, 8, AT), (1, 3, 5, 8, AT)], "tenant_id INT, order_id BIGINT, visitor_key BIGINT, person_id BIGINT, created_at TIMESTAMP")
    assert {r["visitor_key"]: r["person_id"] for r in identity.visitor_person_link(seen, placed).collect()} == {5: 77, 6: 8, 7: None}


def test_shares_of_a_key_hang_together(spark):
    many = [(i, None, "A", None) for i in range(1, 500)] + [(i, f"c{i}", None, None) for i in range(500, 520)] + [(600, "c500", "A", None)]
    got = people(identity.identity_resolve(orders(spark, many)))
    assert got == {i: 1 if i <= 500 or i == 600 else i for i, *_ in many}
    stored = spark.createDataFrame([(1, "phone", "A", 7), (1, "phone", "A", 9), (1, "customer", "c501", 8)], "tenant_id INT, key_type STRING, key_hash STRING, person_id BIGINT")
    run = {(r["node_kind"], r["node_id"]): r["person_id"] for r in identity.identity_incremental(stored, orders(spark, many)).collect()}
    assert run == {("order", i): 7 if i <= 500 or i == 600 else 8 if i == 501 else i for i, *_ in many} | {("person", 7): 7, ("person", 9): 7, ("person", 8): 8}


def test_numbers_of_a_busy_person(spark):
    rng = random.Random(5)
    rows = []
    for o in range(600):
        at = None if o % 97 == 0 else AT + timedelta(seconds=rng.randrange(0, 40 * 3600, 1800))
        rows.append((rng.choice((1, 2)), o, at, rng.choice((5, 5, 5, 6, None)), AT if o % 11 == 0 else None, rng.choice(("paid", "refunded", None))))
    placed = spark.createDataFrame(rows, "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, person_id BIGINT, cancelled_at TIMESTAMP, financial_status STRING")
    tenants = spark.createDataFrame([(1, True), (2, False)], "tenant_id INT, refunded_counts_as_order BOOLEAN")
    got = {r["order_id"]: r["order_sequence"] for r in identity.order_sequence(placed, tenants).collect()}
    seen, want = {}, {}
    for t, o, at, person, cancelled, status in sorted(rows, key=lambda r: (r[2] is not None, r[2] or AT, r[1])):
        if cancelled is None and person is not None and (t == 1 or status != "refunded"):
            seen[t, person] = seen.get((t, person), 0) + 1
            want[o] = seen[t, person]
        else:
            want[o] = None
    assert got == want
