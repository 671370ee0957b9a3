"""Deletion by files, resumable order pulls and attribution from its window only."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import attribution as at
from tallyloom.sources import edits, sinks
from tallyloom.sources.files import TableFiles
from tallyloom.streaming import order_sync, streams

NOW = datetime(2024, 6, 10, 12)


# --- files ---


def make_table(spark, path):
    rows = [(t, k, k % 7 if k % 5 else None, NOW + timedelta(days=k % 3)) for t in (1, 2, 3) for k in range(60)]
    df = spark.createDataFrame(rows, "tenant_id INT, event_uid BIGINT, visitor_key BIGINT, occurred_at TIMESTAMP")
    sinks.sink_events(df, path)
    return rows


def state(folder):
    return {f: (folder / f).stat().st_mtime_ns for f in (str(p.relative_to(folder)) for p in folder.rglob("tenant_id=*/**/*.parquet"))}


def content(spark, path):
    return sorted((r["tenant_id"], r["event_uid"], r["visitor_key"]) for r in spark.read.parquet(path).collect())


def test_purged_tenants_go_by_their_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = make_table(spark, path)
    before = state(tmp_path / "t")
    due = spark.createDataFrame([(2,), (9,)], "tenant_id INT")
    assert [tuple(r) for r in edits.purge_tenants(spark, path, due, "p1").collect()] == [(2, 60)]
    assert state(tmp_path / "t") == {f: t for f, t in before.items() if not f.startswith("tenant_id=2")}
    assert content(spark, path) == sorted((t, k, v) for t, k, v, _ in rows if t != 2)
    assert edits.purge_tenants(spark, path, due, "p2").count() == 0


@pytest.mark.parametrize("crash", ["before", "after", None])
def test_only_files_with_hits_are_rewritten(spark, tmp_path, monkeypatch, crash):
    path = str(tmp_path / "t")
    rows = make_table(spark, path)
    before, whole = state(tmp_path / "t"), content(spark, path)
    hits = spark.createDataFrame([(1, 3), (1, 10), (3, 59), (4, 1), (1, None)], "tenant_id INT, event_uid BIGINT")
    want = sorted((t, k, v) for t, k, v, _ in rows if (t, k) not in {(1, 3), (1, 10), (3, 59)})
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash"))
    if crash:
        with monkeypatch.context() as m:
            m.setattr(TableFiles, "commit" if crash == "before" else "_carry_out", stop)
            with pytest.raises(RuntimeError, match="crash"):
                edits.delete_hits(spark, path, hits, ["tenant_id", "event_uid"], "d1")
        assert content(spark, path) == whole  # the old table, until what was journalled is carried out
        TableFiles(spark, path).recover()
        assert content(spark, path) == (want if crash == "after" else whole)
    assert edits.delete_hits(spark, path, hits, ["tenant_id", "event_uid"], "d1") == (0 if crash == "after" else 3)
    assert content(spark, path) == want
    after = state(tmp_path / "t")
    same = [f for f in before if after.get(f) == before[f]]
    assert len(same) == len(before) - 3
    cleared = edits.clear_hits(spark, path, spark.createDataFrame([(3, 4)], "tenant_id INT, visitor_key BIGINT"), ["tenant_id", "visitor_key"], ("visitor_key",), "c1")
    assert cleared > 0 and content(spark, path) == sorted((t, k, None if (t, v) == (3, 4) else v) for t, k, v in want)
    assert edits.delete_hits(spark, str(tmp_path / "none"), hits, ["tenant_id"], "x") == 0


# --- order pulls ---

ORDER = "tenant_id INT, order_id BIGINT, updated_at TIMESTAMP, total_minor BIGINT"


def test_pulls_go_on_where_they_stopped(spark, tmp_path):
    rows = [(1, k, NOW + timedelta(minutes=k // 2), k) for k in range(25)] + [(2, k, NOW + timedelta(minutes=k), k) for k in range(10)] + [(3, 1, None, 5)]
    source = spark.createDataFrame(rows, ORDER)
    path, orders = str(tmp_path / "cursors"), str(tmp_path / "orders")
    pages = []

    def apply(page, name):
        if len(pages) == 2 and name.startswith("one"):
            raise RuntimeError("crash")
        pages.append((name, sorted((r["tenant_id"], r["order_id"]) for r in page.collect())))
        streams.merge_into_orders(spark, page, orders, name)

    with pytest.raises(RuntimeError, match="crash"):
        order_sync.sync_orders(spark, source, path, apply, "one", page=6)
    marks = {r["tenant_id"]: r for r in order_sync.cursors(spark, path).collect()}
    assert marks[1]["watermark"] is None and marks[1]["token_id"] == 11  # two pages are in, and it is not done
    assert marks[2]["watermark"] == NOW + timedelta(minutes=9) and marks[2]["token_at"] is None
    assert order_sync.sync_orders(spark, source, path, apply, "two", page=6, pages=2) == 2
    assert pages[2][1][0] == (1, 12) and (1, 11) not in pages[2][1]  # the third page of tenant 1, not the first
    assert order_sync.sync_orders(spark, source, path, apply, "three", page=6) >= 1
    marks = {r["tenant_id"]: (r["watermark"], r["token_at"]) for r in order_sync.cursors(spark, path).collect()}
    assert marks == {1: (NOW + timedelta(minutes=12), None), 2: (NOW + timedelta(minutes=9), None)}
    assert streams.read_orders(spark, orders).count() == 35
    # a late order within the overlap comes again, an older one does not; a new tenant is pulled whole
    late = source.unionByName(spark.createDataFrame([(1, 100, NOW + timedelta(minutes=9), 1), (1, 101, NOW + timedelta(minutes=2), 1), (4, 1, NOW - timedelta(days=9), 1)], ORDER))
    order_sync.sync_orders(spark, late, path, apply, "four", page=50)
    got = {(r["tenant_id"], r["order_id"]) for r in streams.read_orders(spark, orders).collect()}
    assert (1, 100) in got and (1, 101) not in got and (4, 1) in got


# --- attribution ---


def test_two_runs_equal_one_and_read_their_days(spark, tmp_path):
    touches = [(1, v, NOW - timedelta(days=d, hours=v), 1000 * v + d, 10 + d if d % 2 else None, 7, 5) for v in range(6) for d in range(0, 90, 3)]
    events = spark.createDataFrame(touches, "tenant_id INT, visitor_key BIGINT, occurred_at TIMESTAMP, event_uid BIGINT, campaign_id BIGINT, referrer_id BIGINT, path_id BIGINT")
    path = str(tmp_path / "events")
    sinks.sink_events(events, path)
    stored = spark.read.parquet(path)
    orders = spark.createDataFrame([(1, 10 * v + k, NOW - timedelta(days=20 * k, hours=3), v, None) for v in range(7) for k in range(3)], "tenant_id INT, order_id BIGINT, created_at TIMESTAMP, visitor_key BIGINT, person_id BIGINT")
    visitors = spark.createDataFrame([], "tenant_id INT, visitor_key BIGINT, person_id BIGINT")
    whose = at.attr_visitor_set(orders, visitors)
    full = at.attr_pixel_first_last(orders, whose, at.attr_touches(events, whose))
    none = spark.createDataFrame([], full.schema)
    first = at.attr_resolve_due(orders.where(F.col("created_at") < NOW - timedelta(days=10)), none, stored, visitors, NOW - timedelta(days=15))
    second = at.attr_resolve_due(orders, first, stored, visitors, NOW)
    assert sorted(map(tuple, second.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    due = at.attr_pending(orders, first, NOW, None)
    window = at.touch_window(due)
    plan = at.attr_touches(stored, whose, window=window)._jdf.queryExecution().executedPlan().toString()
    assert window[0] == NOW - timedelta(days=30, hours=3)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2024-05-11" in filters and "<= 2024-06-10" in filters
    assert at.attr_resolve_due(orders.limit(0), full, stored, visitors, NOW) is full
