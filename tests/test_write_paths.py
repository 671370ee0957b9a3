"""Write paths under replays, late versions, limits, waiting files and crashes."""

import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ingest, orders, rollups
from tallyloom.sources.files import PartStore, TableFiles
from tallyloom.streaming import key_index, streams

from test_ingest_orders import MS, NOW, line, write_feed

DAY_MS = 86_400_000


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([(1, "salt", "Asia/Kolkata"), (2, "salt", "UTC")], "tenant_id INT, salt STRING, iana_timezone STRING")


def ingest_all(spark, tmp_path, tenants, now=NOW, mark="mark", **more):
    streams.stream_ingest(spark, str(tmp_path / "feed"), str(tmp_path / "events"), str(tmp_path / mark), tenants, lambda: now, **more).awaitTermination()
    return spark.read.parquet(str(tmp_path / "events"))


# --- one event, for good ---


def test_a_replay_on_a_later_day_with_a_bad_clock_adds_nothing(spark, tenants, tmp_path):
    feed = tmp_path / "feed"
    write_feed(feed, "1-2024060811.ndjson", [line(id="a", ts=12, _rx=MS - 2 * DAY_MS), line(id="b", ts=MS - 2 * DAY_MS), line(id="a", ts=12, _rx=MS, _t=2)])
    assert ingest_all(spark, tmp_path, tenants).count() == 3
    write_feed(feed, "1-2024061011.ndjson", [line(id="a", ts=12, _rx=MS), line(id="b", ts=MS), line(id="c", ts=12)])
    rows = ingest_all(spark, tmp_path, tenants)
    assert rows.count() == 4 and rows.select("tenant_id", "event_uid").distinct().count() == 4
    # another checkpoint reads all files again: they are all known
    assert ingest_all(spark, tmp_path, tenants, mark="other").count() == 4


def test_times_as_text_and_with_fractions(spark, tenants, tmp_path):
    write_feed(tmp_path / "feed", "1-2024061011.ndjson", [line(id="a", ts=str(MS - 60_000)), line(id="b", ts=MS - 60_000 + 0.75), line(id="c", ts=f"{MS - 60_000}abc"), line(id="d", ts="soon"), line(id="e", ts=None)])
    rows = ingest_all(spark, tmp_path, tenants)
    at = NOW - timedelta(minutes=1)
    assert sorted(r["occurred_at"] for r in rows.collect()) == [at, at, at, NOW, NOW]


def test_a_crash_before_and_after_the_journal(spark, tenants, tmp_path, monkeypatch):
    feed = tmp_path / "feed"
    write_feed(feed, "1-2024061010.ndjson", [line(id="a"), line(id="b")])
    commit = TableFiles.commit
    monkeypatch.setattr(TableFiles, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash before")))
    with pytest.raises(Exception, match="crash before"):
        ingest_all(spark, tmp_path, tenants)
    monkeypatch.setattr(TableFiles, "commit", commit)
    carry = TableFiles._carry_out
    monkeypatch.setattr(TableFiles, "_carry_out", lambda *a: (_ for _ in ()).throw(RuntimeError("crash after")))
    with pytest.raises(Exception, match="crash after"):
        ingest_all(spark, tmp_path, tenants)
    monkeypatch.setattr(TableFiles, "_carry_out", carry)
    assert ingest_all(spark, tmp_path, tenants).count() == 2
    write_feed(feed, "1-2024061011.ndjson", [line(id="a"), line(id="c")])
    assert ingest_all(spark, tmp_path, tenants).count() == 3


def test_index_reads_only_what_filters_leave(spark, tmp_path, monkeypatch):
    index = key_index.KeyIndex(spark, str(tmp_path / "keys"))
    frame = lambda a, b, t=1: spark.range(a, b).select(F.lit(t).alias("tenant_id"), F.xxhash64("id").alias("event_uid"))
    for k in range(9):
        index.add(frame(100 * k, 100 * k + 100), f"c{k}")
    index.add(frame(0, 50, 2), "other")
    index.add(frame(0, 0), "empty")
    ask = lambda df: index.stored(df).count()
    assert ask(frame(850, 1000)) == 50 and ask(frame(40, 60, 2)) == 10 and ask(frame(5000, 6000)) == 0
    assert index.stored(frame(0, 10), but="c0").count() == 0
    used = index.stored(frame(5, 6)).inputFiles()
    assert all("commit=c0/tenant_id=1" in f for f in used if "/keys/commit=" in f)
    assert index.merge_commits() == 9 and len(index.commits()) == 3
    assert ask(frame(850, 1000)) == 50 and ask(frame(0, 900)) == 900


# --- orders in any order of arrival ---

VERSION = "tenant_id INT, order_id BIGINT, updated_at TIMESTAMP, created_at TIMESTAMP, currency STRING, landing_site STRING, total_minor BIGINT, email_hash STRING, phone_hash STRING"


def versions_of(spark, rows):
    at = lambda m: None if m is None else NOW + timedelta(minutes=m)
    return spark.createDataFrame([(1, i, at(m), at(m), cur, site, total, mail, phone) for i, m, cur, site, total, mail, phone in rows], VERSION)


ROWS = [
    (1, 60, "INR", "A", 10, "h1", None), (1, 90, None, "B", 20, None, "p1"), (1, 120, "USD", "C", 30, None, None), (1, 120, "EUR", "D", 31, "h2", None),
    (2, None, "GBP", None, 5, "n", "n"), (2, 5, "INR", "E", 6, None, None), (2, 5, "INR", "E", 6, None, None),
]


def test_orders_merge_in_any_order_and_grouping(spark):
    whole = orders.orders_merge(versions_of(spark, ROWS)).collect()
    want = {r["order_id"]: r for r in whole}
    assert (want[1]["landing_site"], want[1]["currency"], want[1]["email_hash"], want[1]["phone_hash"]) == ("A", "INR", "h2", "p1") and want[1]["total_minor"] in (30, 31)
    assert (want[2]["currency"], want[2]["landing_site"], want[2]["total_minor"], want[2]["email_hash"]) == ("GBP", None, 6, "n")
    first = ROWS[:4]
    states = [orders.order_states(versions_of(spark, [r])).collect()[0] for r in first]
    schema = orders.order_states(versions_of(spark, first)).schema
    for arrival in itertools.permutations(range(4)):
        state = spark.createDataFrame([states[arrival[0]]], schema)
        for k in arrival[1:]:
            state = orders.fold_states(state.unionByName(spark.createDataFrame([states[k]], schema)))
        assert orders.orders_of_states(state).collect() == [want[1]], arrival
    left, right = (orders.fold_states(spark.createDataFrame([states[a], states[b]], schema)) for a, b in ((0, 2), (3, 1)))
    assert orders.orders_of_states(orders.fold_states(left.unionByName(right))).collect() == [want[1]]


def test_streamed_orders_keep_first_values_of_late_versions(spark, tmp_path):
    path = str(tmp_path / "orders")
    for k, arrival in enumerate(([0, 2], [3], [1])):
        versions_of(spark, [ROWS[i] for i in arrival]).coalesce(1).write.parquet(str(tmp_path / "feed" / str(k)))
        run = streams.stream_order_merge(spark.readStream.schema(VERSION).parquet(f"{tmp_path}/feed/*"), path, str(tmp_path / "mark"))
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    assert streams.read_orders(spark, path).select(*VERSION.replace(",", "").split()[::2]).collect() == orders.orders_merge(versions_of(spark, ROWS[:4])).collect()


def test_part_store_repeats_and_retires(spark, tmp_path):
    add = lambda df: df.groupBy("part", "k").agg(F.sum("n").alias("n"))
    store = PartStore(spark, str(tmp_path / "s"), ("part",), add, most=4)
    frame = lambda rows: spark.createDataFrame(rows, "part INT, k INT, n BIGINT")
    assert store.read() is None
    for i in range(12):
        assert store.merge(frame([(i % 6, 1, 1), (i % 6, 2, 5)]), f"c{i}")
        assert not store.merge(frame([(i % 6, 1, 1)]), f"c{i}")
    assert sorted(map(tuple, store.read().select("part", "k", "n").collect())) == [(p, k, n) for p in range(6) for k, n in ((1, 2), (2, 10))]
    assert len(store.folder.names("data")) <= 2 * 4 + 2 and len(store.folder.names("manifest")) == 2
    assert store.read(spark.createDataFrame([(3,)], "part INT")).count() == 2 and store.read(spark.createDataFrame([(9,)], "part INT")).count() == 0
    store.merge(frame([(7, 1, 1)]), "last", keep=F.col("part") >= 4)
    assert {r["part"] for r in store.read().collect()} == {4, 5, 7}


# --- limits ---


def test_rate_limit_drops_across_batches_and_restarts(spark, tmp_path):
    schema = "batch_id BIGINT, ip STRING, received_at TIMESTAMP"
    rows = [(k, f"10.0.0.{k % 3 if k % 5 else 9}", NOW + timedelta(seconds=k)) for k in range(400)] + [(1000 + k, None, NOW) for k in range(7)]
    rows.sort(key=lambda r: (r[2], r[0]))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed/*")
    for k in range(3):
        for j in range(2):
            at = (2 * k + j) * 70
            spark.createDataFrame(rows[at : at + 70] if (k, j) != (2, 1) else rows[at:], schema).coalesce(1).write.parquet(str(tmp_path / "feed" / f"{k}{j}"))
        streams.stream_rate_limit(read(), str(tmp_path / "out"), str(tmp_path / "mark"), most=6).awaitTermination()
    got = sorted(r["batch_id"] for r in streams.read_passed(spark, str(tmp_path / "out")).collect())
    want = sorted(r["batch_id"] for r in ingest.ingest_rate_limit(spark.createDataFrame(rows, schema), 6).collect())
    assert got == want and 0 < len(want) < len(rows)


# --- sessions ---


def test_live_sessions_equal_the_batch(spark, tenants, tmp_path):
    midnight = datetime(2024, 6, 9, 18, 30)  # in Kolkata
    at = lambda s: midnight + timedelta(seconds=s)
    seconds = [-10, 10, 1810, 3611, 7300, 7300 + 1799, 7300 + 3600, 40_000, 40_000 + 1801, -86_400, 86_399, 86_401]
    rows = [(t, v, at(s + 7 * v)) for s in seconds for v in (0, 5) for t in (1, 2)] + [(3, 1, NOW)]
    schema = "tenant_id INT, visitor_key BIGINT, occurred_at TIMESTAMP"
    late = [r for k, r in enumerate(rows) if k % 3 == 1]
    for name, part in (("a", [r for r in rows if r not in late]), ("b", late), ("c", late[:4])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "feed" / name))
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/*")
        streams.stream_sessions(source, str(tmp_path / "slots"), str(tmp_path / "rollup"), str(tmp_path / "mark"), tenants).awaitTermination()
    got = {(r["tenant_id"], str(r["stat_date"]), r["sessions"]) for r in spark.read.parquet(str(tmp_path / "rollup")).collect()}
    batch = rollups.sessions_daily(rollups.with_day(spark.createDataFrame(rows, schema), tenants, "occurred_at"))
    assert got == {(r["tenant_id"], str(r["stat_date"]), r["sessions"]) for r in batch.collect()}


def test_session_windows_split_at_the_gap_itself(spark, tmp_path):
    gap, tick = timedelta(minutes=30), timedelta(microseconds=1)
    schema = "tenant_id INT, visitor_key BIGINT, occurred_at TIMESTAMP"
    rows = [(1, v, NOW + k * (gap + step)) for v, step in ((1, -tick), (2, timedelta(0)), (3, tick)) for k in range(3)]
    rows += [(1, None, NOW), (1, None, NOW + gap), (1, None, NOW + gap), (1, 4, NOW), (2, 4, NOW + gap / 2), (1, 4, NOW + gap)]
    want = sorted([(1, 1, NOW, NOW + 3 * gap - 2 * tick, 3), (1, None, NOW, NOW + gap, 1), (1, None, NOW + gap, NOW + 2 * gap, 2), (2, 4, NOW + gap / 2, NOW + gap * 3 / 2, 1)]
        + [(1, v, NOW + k * (gap + step), NOW + gap + k * (gap + step), 1) for v, step in ((2, timedelta(0)), (3, tick)) for k in range(3)]
        + [(1, 4, NOW, NOW + gap, 1), (1, 4, NOW + gap, NOW + 2 * gap, 1)], key=repr)
    got = streams.stream_session_windows(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == want
    for name in ("a", "b"):  # sessions in the state meet those of a later batch
        spark.createDataFrame([r for k, r in enumerate(rows) if "ab"[k % 2] == name], schema).coalesce(1).write.parquet(str(tmp_path / "feed" / name))
        source = streams.stream_session_windows(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/*"))
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / "out"))
        source.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == want


# --- files that wait as a whole ---


def test_a_file_waits_until_its_day_has_a_place(spark, tenants, tmp_path):
    feed, audit = tmp_path / "feed", str(tmp_path / "audit")
    places = lambda end: spark.createDataFrame([(1, datetime(2024, 1, 1).date(), end.date())], "shard_id INT, valid_from DATE, valid_to DATE")
    write_feed(feed, "1-2024060910.ndjson", [line(id="a", ts=MS - 2 * DAY_MS), line(id="x", ts=MS - 2 * DAY_MS)])
    write_feed(feed, "a b-2024061010.ndjson", [line(id="b", ts=MS - 2 * DAY_MS), line(id="c", ts=MS), line(id="a"), "{broken"])
    short, long = places(datetime(2024, 6, 9)), places(datetime(2024, 12, 31))
    assert ingest_all(spark, tmp_path, tenants, registry=short, audit=audit).count() == 2
    status = {r["file_name"]: (r["status"], r["accepted"], r["duplicate"], r["malformed"]) for r in spark.read.parquet(audit).collect()}
    assert status == {"1-2024060910.ndjson": ("ok", 2, 0, 0), "a%20b-2024061010.ndjson": ("failed", 0, 0, 1)}
    assert [r["_file"] for r in streams.held_files(spark, str(tmp_path / "events")).collect()] == ["a%20b-2024061010.ndjson"]
    # offered again and still without a place; a line of it may be stored by another file
    write_feed(feed, "1-2024061011.ndjson", [line(id="b", ts=MS - 2 * DAY_MS)])
    assert ingest_all(spark, tmp_path, tenants, registry=short, audit=audit).count() == 3
    assert ingest_all(spark, tmp_path, tenants, registry=long, audit=audit).count() == 4
    assert streams.held_files(spark, str(tmp_path / "events")).count() == 0
    assert ingest_all(spark, tmp_path, tenants, registry=long, audit=audit).count() == 4
