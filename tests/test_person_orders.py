"""A merge of persons renumbers and recounts only what it touches, and comes to the same as doing all anew."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import identity, rollups
from tallyloom.streaming import person_orders as po

NOW = datetime(2024, 6, 10, 12)
ORDERS = "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, cancelled_at TIMESTAMP, financial_status STRING, total_minor BIGINT, refunded_minor BIGINT, customer_hash STRING, phone_hash STRING, email_hash STRING"


def order(k, customer=None, phone=None, days=0, tenant=1, cancelled=False):
    at = NOW - timedelta(days=days, minutes=k)
    return (tenant, k, at, at if cancelled else None, "PAID", 100 + k, 0, customer, phone, None)


def test_only_touched_persons_and_days(spark, tmp_path):
    tenants = spark.createDataFrame([(1, "UTC", True), (2, "UTC", True)], "tenant_id INT, iana_timezone STRING, refunded_counts_as_order BOOLEAN")
    frame = lambda rows: spark.createDataFrame(rows, ORDERS)
    steps = [
        [order(k, f"c{k % 5}", days=k) for k in range(10, 40)] + [order(50, phone="p9", days=3), order(51, "x", tenant=2, days=1)],
        [order(60, "c1", "p9", days=30), order(61, "c7", days=0), order(62, None, None, days=2)],  # merges c1 with p9
        [order(63, "c7", days=1, cancelled=True)],
    ]
    path, rollup = str(tmp_path / "o"), str(tmp_path / "r")
    keys, done, touched_days = None, [], []
    for run, rows in enumerate(steps):
        new = frame(rows)
        stored = keys if keys is not None else spark.createDataFrame([], "tenant_id INT, key_type STRING, key_hash STRING, person_id BIGINT")
        found = identity.identity_incremental(stored, new)
        po.apply_identity(spark, path, found, new, tenants, run)
        po.apply_identity(spark, path, found, new, tenants, run)  # repeated: nothing happens
        touched_days.append(po.refresh_days(spark, path, rollup, rollups.day_orders))
        done += rows
        current = po.stored_orders(spark, path)
        keys = spark.createDataFrame(identity.identity_keys(frame(done)).join(current.select("tenant_id", "order_id", "person_id"), ["tenant_id", "order_id"]).select("tenant_id", "key_type", "key_hash", "person_id").distinct().collect(), "tenant_id INT, key_type STRING, key_hash STRING, person_id BIGINT")
    # all anew, with the stored persons
    got = current.select("tenant_id", "order_id", "person_id", "order_sequence").collect()
    full = rollups.with_day(identity.order_sequence(frame(done).join(current.select("tenant_id", "order_id", "person_id"), ["tenant_id", "order_id"]), tenants), tenants, "created_at")
    assert sorted(map(tuple, got)) == sorted(map(tuple, full.select("tenant_id", "order_id", "person_id", "order_sequence").collect()))
    groups = {r["order_id"]: r["person_id"] for r in got}
    assert groups[50] == groups[60] == groups[11] and len(got) == len(done) and groups[61] == groups[63] != groups[62]
    want = {(r["tenant_id"], str(r["stat_date"])): tuple(r)[2:] for r in rollups.day_orders(full).collect()}
    columns = rollups.day_orders(full).columns[2:]
    assert {(r["tenant_id"], str(r["stat_date"])): tuple(r[c] for c in columns) for r in spark.read.parquet(rollup).collect()} == want
    # the second run touched the merged person and two new ones; the third a day only
    assert touched_days[0] == len({(r[0], r[2].date()) for r in steps[0]}) and touched_days[1] < touched_days[0] and touched_days[2] == 1
    parts = spark.read.parquet(f"{path}/persons/data/version=2").select("part").distinct().count()
    assert parts == 1
