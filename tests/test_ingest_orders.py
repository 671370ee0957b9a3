import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.functions import exprs
from tallyloom.operators import dims, ingest, monitors, orders
from tallyloom.plans import pipeline_queries
from tallyloom.sources import feeds, sinks
from tallyloom.streaming import streams

NOW = datetime(2024, 6, 10, 12)
MS = int((NOW - datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([(1, "salt")], "tenant_id INT, salt STRING")


def line(**fields):
    base = {"n": "page_viewed", "s": 1, "cid": "c1", "ts": MS - 60_000, "_t": 1, "_rx": MS, "_ip": "10.0.0.1", "_ua": "x", "u": "https://a.example/products/x?utm_source=Insta%ff&utm_source=two&gclid=1"}
    return json.dumps(base | fields)


def write_feed(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def shred(raw, tenants):
    return ingest.event_shred(ingest.event_map_type(raw.where("_corrupt is null")), tenants, NOW)


def test_feed_to_events(spark, tenants, tmp_path):
    feed = tmp_path / "feed"
    write_feed(feed, "1-2024061011.ndjson", [
        line(id="a"), line(id="b", p="99e", q="70000", a="1e30"), line(id="c", ts=12, p="-4", cid=""), line(id="c", ts=12, p="-4", cid=""), line(n="input_changed"), "{broken", "", line(n=" Product_Viewed ", id="", p="12.6"),
    ])
    write_feed(feed, "1-2024061012.ndjson", [line(id="open")])
    raw = feeds.src_event_feed(spark, str(feed), NOW)
    rows = {(r["product_id"], r["qty"], r["amount_minor"], r["visitor_key"] == 0, r["event_type"]) for r in ingest.event_dedup(shred(raw, tenants)).collect()}
    assert rows == {(None, None, None, False, 1), (None, 65535, 4294967295, False, 1), (None, None, None, True, 1), (13, None, None, False, 3)}
    audit = ingest.import_audit(ingest.classify_lines(ingest.event_map_type(raw))).collect()
    assert [(a["accepted"], a["duplicate"], a["skipped"], a["malformed"]) for a in audit] == [(4, 1, 1, 1)]
    late = shred(raw.where("id = 'c'"), tenants).first()
    assert late["occurred_at"] == NOW  # an impossible client clock gives way to the receive time


def test_keys_follow_their_definition(spark):
    row = spark.range(1).select(exprs.key63(F.lit("1:é")).alias("k"), exprs.hex_digest(F.lit("x")).alias("h")).first()
    assert row["k"] == int.from_bytes(hashlib.sha256("1:é".encode()).digest()[:8], "big") % 2**63
    assert row["h"] == hashlib.sha256(b"x").hexdigest()[:32]


@pytest.mark.parametrize("secret", [b"short", b"k" * 100])
def test_hmac(spark, secret):
    inner, outer = exprs.hmac_pads(secret)
    got = spark.range(1).select(exprs.hmac_hex(F.lit("mail@x.de"), F.lit(inner), F.lit(outer)).alias("h")).first()["h"]
    assert got == hmac.new(secret, b"mail@x.de", hashlib.sha256).hexdigest()[:32]


def test_contacts(spark):
    rows = [("+91 98765 43210", " A.b@X.com "), ("098-765-43210", "nomail"), ("12345", None), ("919876543210123", ""), (None, None), ("9198765432", None)]
    df = spark.createDataFrame(rows, "phone STRING, email STRING").select(orders.normal_phone(F.col("phone")).alias("p"), orders.normal_email(F.col("email")).alias("e"))
    assert [tuple(r) for r in df.collect()] == [("9876543210", "a.b@x.com"), ("9876543210", None), (None, None), (None, None), (None, None), ("9198765432", None)]


def test_urls_and_campaigns(spark):
    urls = ["https://User@Shop.Example:8443/products/a b|c?utm_source=x&utm_source=+two%20&utm_medium=&fbclid#frag", "/cart", "https://x.example", "https://x.example/?utm_term=50%", None, ""]
    df = spark.createDataFrame([(1, u) for u in urls], "tenant_id INT, url STRING")
    paths = {(r["path"], r["page_type"]) for r in dims.dim_path(df).collect()}
    assert paths == {("/products/a b|c", "product"), ("/cart", "cart"), ("/", "home")}
    assert {r["referrer_host"] for r in dims.dim_referrer(df, "url").collect()} == {"shop.example", "x.example", None}
    got = {(r["utm_source"], r["utm_medium"], r["utm_term"], r["has_fbclid"]) for r in dims.dim_campaign(df).collect()}
    assert got == {("two", None, None, True), (None, None, "50%", False)}


def test_geo_prefers_the_narrow_range(spark):
    ranges = spark.createDataFrame([(0, 2**32 - 1, "xx", None, None, 0.0, 0.0), (167772160, 167772200, "in", "r", "c", 1.0, 2.0)], "ip_start BIGINT, ip_end BIGINT, country STRING, region STRING, city STRING, lat DOUBLE, lon DOUBLE")
    rows = spark.createDataFrame([(1, "10.0.0.5"), (2, "10.0.1.0"), (3, "::1"), (4, None), (5, "10.0.0.300")], "id INT, ip STRING")
    got = {r["id"]: r["country"] for r in ingest.geo_enrich(rows, ranges).collect()}
    assert got == {1: "in", 2: "xx", 3: None, 4: None, 5: None}


def test_gate_reasons(spark):
    stores = spark.createDataFrame([(1, "k", "active"), (2, "gone", "uninstalled")], "tenant_id INT, write_key STRING, status STRING")
    batches = spark.createDataFrame([("k", "x" * 65536, 100), ("k", "x" * 65537, 1), ("k", "x", 0), ("k", "x", 101), ("gone", "x", 1), (None, "x", 1)], "write_key STRING, body STRING, n_events INT")
    assert sorted(str(r["reject_reason"]) for r in ingest.ingest_gate(batches, stores).collect()) == ["None", "empty", "too_large", "too_many_events", "unknown_key", "unknown_key"]


def test_stream_ingest_replay_and_restart(spark, tenants, tmp_path):
    feed, table, mark = tmp_path / "feed", str(tmp_path / "events"), str(tmp_path / "mark")
    write_feed(feed, "1-2024061009.ndjson", [line(id="a"), line(id="b")])
    run = lambda: streams.stream_ingest(spark, str(feed), table, mark, tenants, lambda: NOW).awaitTermination()
    run()
    write_feed(feed, "1-2024061010.ndjson", [line(id="b"), line(id="c"), line(id="c"), "{"])
    run()
    run()
    assert spark.read.parquet(table).count() == 3


def test_open_hours_wait_until_they_close(spark, tenants, tmp_path):
    """Lines appended to an hour that is still open are not lost; both layouts of the feed, and its audit."""
    feed, table, mark, audit = tmp_path / "feed", str(tmp_path / "events"), str(tmp_path / "mark"), str(tmp_path / "audit")
    write_feed(feed, "1-2024061010.ndjson", [line(id="a"), "{broken"])
    write_feed(feed, "1-2024061011.ndjson", [line(id="b")])
    write_feed(feed / "hour=2024061009", "part.json", [line(id="x"), line(n="input_changed", id="y")])
    run = lambda now: streams.stream_ingest(spark, str(feed), table, mark, tenants, lambda: now, audit=audit).awaitTermination()
    run(datetime(2024, 6, 10, 11, 30))
    assert spark.read.parquet(table).count() == 2
    write_feed(feed, "1-2024061011.ndjson", [line(id="b"), line(id="c")])  # the hour was open: more came
    run(datetime(2024, 6, 10, 11, 59))
    assert spark.read.parquet(table).count() == 2
    run(datetime(2024, 6, 10, 12))
    assert spark.read.parquet(table).count() == 4
    counts = spark.read.parquet(audit).groupBy().sum("accepted", "duplicate", "skipped", "malformed").first()
    assert tuple(counts) == (4, 0, 1, 1)


def test_ingest_with_nothing_closed(spark, tenants, tmp_path):
    write_feed(tmp_path / "feed", "1-2024061012.ndjson", [line(id="a")])
    streams.stream_ingest(spark, str(tmp_path / "feed"), str(tmp_path / "events"), str(tmp_path / "mark"), tenants, lambda: NOW).awaitTermination()
    assert not (tmp_path / "events").exists()


ORDER = "tenant_id INT, order_id BIGINT, updated_at TIMESTAMP, total_minor BIGINT"


def merge_orders(spark, rows, feed, name, path, mark):
    spark.createDataFrame(rows, ORDER).coalesce(1).write.parquet(str(feed / name))
    run = streams.stream_order_merge(spark.readStream.schema(ORDER).parquet(f"{feed}/*"), path, mark)
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def test_order_merge_touches_parts_and_goes_on(spark, tmp_path):
    feed, path = tmp_path / "feed", str(tmp_path / "orders")
    at = lambda h: NOW + timedelta(hours=h)
    merge_orders(spark, [(1, i, at(0), 10) for i in range(300)], feed, "a", path, str(tmp_path / "m1"))
    merge_orders(spark, [(1, 7, at(1), 11), (1, 8, at(-1), 12)], feed, "b", path, str(tmp_path / "m1"))
    got = {r["order_id"]: r["total_minor"] for r in streams.read_orders(spark, path).collect()}
    assert len(got) == 300 and (got[7], got[8], got[9]) == (11, 10, 10)
    second = spark.read.parquet(f"{path}/data/version=1")
    assert second.select("part").distinct().count() <= 2  # only the touched parts were written
    # a fresh checkpoint on stored orders: all files come again, and nothing is lost or doubled
    merge_orders(spark, [(2, 1, at(0), 5)], feed, "c", path, str(tmp_path / "m2"))
    rows = streams.read_orders(spark, path).collect()
    assert len(rows) == 301 and {r["order_id"]: r["total_minor"] for r in rows if r["tenant_id"] == 1} == got
    assert streams.drop_old_versions(spark, path) >= 1
    assert streams.read_orders(spark, path).count() == 301


def test_order_merge_refuses_a_missing_predecessor(spark, tmp_path):
    import shutil

    feed, path, mark = tmp_path / "feed", str(tmp_path / "orders"), str(tmp_path / "m")
    merge_orders(spark, [(1, 1, NOW, 1)], feed, "a", path, mark)
    shutil.move(path, str(tmp_path / "elsewhere"))
    with pytest.raises(Exception, match="finds no stored orders"):
        merge_orders(spark, [(1, 2, NOW, 2)], feed, "b", path, mark)


def test_file_listings(spark, tmp_path):
    feed = tmp_path / "feed"
    write_feed(feed, "1-2024061010.ndjson", ["x" * 99])
    write_feed(feed, "1-2024061012.ndjson", ["y"])
    files = monitors.feed_files(spark, str(feed), NOW).collect()
    assert [(f["file_name"], f["bytes"]) for f in files] == [("1-2024061010.ndjson", 100)]
    df = spark.range(1000).selectExpr("id", "id % 2 as day")
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    sizes = {r["partition_key"]: r["sum(bytes)"] for r in monitors.file_sizes(spark, str(tmp_path / "t"), "day").groupBy("partition_key").sum("bytes").collect()}
    assert sizes == {str(d): sum(f.stat().st_size for f in (tmp_path / "t" / f"day={d}").glob("*.parquet")) for d in (0, 1)}


def test_unknown_currencies_are_null(spark, tenants, tmp_path):
    write_feed(tmp_path / "feed", "1-2024061011.ndjson", [line(id=str(i), c=c) for i, c in enumerate(("inr", "Usd", "xyz", "", None))])
    rows = shred(feeds.src_event_feed(spark, str(tmp_path / "feed"), NOW), tenants).select("currency").collect()
    assert sorted(str(r["currency"]) for r in rows) == ["INR", "None", "None", "None", "USD"]


def test_rollup_sink_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "rollup")
    frame = lambda rows: spark.createDataFrame(rows, "tenant_id INT, stat_date STRING, v INT")
    sinks.sink_rollup(frame([(1, "2024-06-01", 1), (1, "2024-06-02", 2), (2, "2024-06-01", 9)]), path)
    sinks.sink_rollup(frame([(1, "2024-06-02", 5)]), path)
    got = {(r["tenant_id"], str(r["stat_date"]), r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "2024-06-01", 1), (1, "2024-06-02", 5), (2, "2024-06-01", 9)}


def test_merge_keeps_first_values_and_hashes(spark):
    rows = [(1, 1, NOW, NOW, "INR", 10, "h"), (1, 1, NOW + timedelta(1), NOW + timedelta(1), "USD", 20, None)]
    df = spark.createDataFrame(rows, "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP, currency STRING, total_minor BIGINT, email_hash STRING")
    for versions in (df, df.orderBy(F.desc("updated_at"))):
        r = orders.orders_merge(versions).first()
        assert (r["created_at"], r["currency"], r["total_minor"], r["email_hash"]) == (NOW, "INR", 20, "h")


def test_quarantine_report(spark):
    rejects = spark.createDataFrame([(1, i, NOW, "no id") for i in range(8)], "tenant_id INT, order_id BIGINT, updated_at TIMESTAMP, reason STRING")
    row = orders.quarantine_report(rejects).first()
    assert row["rejected"] == 8 and len(row["examples"]) == 5


def test_order_documents_land_compressed_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline_queries, "folder_of", lambda s: str(tmp_path))
    monkeypatch.setattr(sinks, "FEED_DOCUMENTS", 100, raising=False)
    assert pipeline_queries.src_orders_feed(spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    files = list((tmp_path / "orders").glob("part-*"))
    text = spark.read.text(str(tmp_path / "orders")).agg(F.sum(F.length("value"))).first()[0]
    assert 5 * sum(f.stat().st_size for f in files) < text and len(files) >= 15
    landed = feeds.src_orders_feed(spark, str(tmp_path / "orders")).select("id", "totalPriceSet", F.explode("lineItems.nodes").alias("i"))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").join(spark.read.parquet(f"{DATA}/orders.parquet"), F.expr("l_orderkey = o_orderkey"))
    want = lines.selectExpr(
        "concat('gid://shop/Order/', o_orderkey)", "string(round(o_totalprice, 2))", "concat('gid://shop/LineItem/', l_orderkey * 1000 + l_partkey % 1000)", "concat('gid://shop/Product/', l_partkey)",
        "if(l_linenumber = 2, null, int(l_quantity))", "string(round(l_extendedprice, 2))",
    )
    got = landed.select("id", "totalPriceSet.shopMoney.amount", "i.id", "i.product.id", "i.quantity", "i.originalUnitPriceSet.shopMoney.amount")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_order_lines_are_shuffled_bare(spark):
    plan = pipeline_queries.raw_orders(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(l_orderkey", 1)[1].split("Scan", 1)[0]
    assert "l_partkey" in below and "gid://" not in below
