"""Loads in chunks, optimiser statistics, joined histories, deep pages, digests."""

from __future__ import annotations

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.load import load_chunks, main, table_counts
from tallyline.operators import audits, projection, reports
from tallyline.operators import validate as V
from tallyline.sources import tables
from tallyline.sources.store import EventStore
from tests.conftest import Factory
from tests.test_validate import GOOD


def _event(i: int, **kw) -> dict:
    return dict(GOOD, event_id=f"00000000-0000-4000-8000-{i:012x}", transaction_id=f"00000000-0000-4000-9000-{i // 2:012x}", **kw)


def _folder(root: str, files: list[list[dict]], lines: bool = True) -> str:
    path = os.path.join(root, "in")
    os.makedirs(path)
    for n, events in enumerate(files):
        with open(os.path.join(path, f"{n:02d}.json"), "w") as f:
            f.write("\n".join(map(json.dumps, events)) if lines else json.dumps(events))
        os.utime(f.name, (1_700_000_000 + n, 1_700_000_000 + n))   # the file source reads the oldest first
    return path


@pytest.mark.parametrize("lines", [True, False])
def test_a_killed_load_goes_on_with_the_next_chunk(spark, tmp_root, monkeypatch, lines):
    files = [[_event(4 * n + i) for i in range(4)] for n in range(3)]
    files[2].append(_event(0))                      # a replay of the first chunk
    path = _folder(tmp_root, files, lines)
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    seen, real = [], EventStore.ingest

    def dies(self, deliveries, *a, **kw):
        if len(seen) == 2:
            raise RuntimeError("killed")
        seen.append(deliveries.count())
        return real(self, deliveries, *a, **kw)

    monkeypatch.setattr(EventStore, "ingest", dies)
    with pytest.raises(Exception, match="killed"):
        load_chunks(spark, path, store, "one", lines=lines)
    assert store.chunk_totals("load:one").first()["chunks"] == 2 and store.log().count() == 8
    monkeypatch.setattr(EventStore, "ingest", lambda self, d, *a, **kw: (seen.append(d.count()), real(self, d, *a, **kw))[1])
    totals = load_chunks(spark, path, store, "one", lines=lines)
    assert seen == [4, 4, 5]                     # no finished chunk is read again
    assert totals == {"chunks": 3, "received": 13, "ingested": 12, "duplicates": 1, "rejected": 0}
    assert load_chunks(spark, path, store, "one", lines=lines) == totals and len(seen) == 3
    assert table_counts(store) == {"events": 12, "transactions": 6, "merchants": 1}


def test_chunked_load_validates_all_first_or_sets_aside(spark, tmp_root):
    path = _folder(tmp_root, [[_event(0), _event(1)], [_event(2), _event(3, currency="RUPEES")]])
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    with pytest.raises(V.ValidationFailed):
        load_chunks(spark, path, store, "strict")
    assert store.log() is None
    got = load_chunks(spark, path, store, "lenient", on_error="quarantine", most_chunks=1)
    assert got["chunks"] == 1 and got["received"] == 2
    got = load_chunks(spark, path, store, "lenient", on_error="quarantine")
    assert got == {"chunks": 2, "received": 3, "ingested": 3, "duplicates": 0, "rejected": 1}
    assert spark.read.parquet(store.quarantine_path).count() == 1
    for bad in ({"files_per_chunk": 0}, {"most_chunks": 0}):
        with pytest.raises(ValueError):
            load_chunks(spark, path, store, "x", **bad)


def test_loader_cli_resumes(spark, tmp_root, capsys):
    path = _folder(tmp_root, [[_event(0)], [_event(1)]])
    args = ["--file", path, "--store", os.path.join(tmp_root, "store"), "--lines", "--resume", "cli"]
    assert main([*args, "--most-chunks", "1"]) == 0
    assert "chunks            1" in capsys.readouterr().out
    assert main(args) == 0
    out = capsys.readouterr().out
    assert "chunks            2" in out and "stored events            2" in out


def test_statistics_change_a_join_side(spark, tmp_root):
    """Before ANALYZE a filtered table counts with its whole size and is sorted
    for the join; with column statistics its few rows are broadcast."""
    big, other = os.path.join(tmp_root, "big"), os.path.join(tmp_root, "other")
    spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 500).alias("g"), F.lit("x" * 40).alias("pad")).write.parquet(big)
    spark.range(20_000).select(F.col("id").alias("k"), F.lit("y" * 40).alias("pad2")).write.parquet(other)
    before = {k: spark.conf.get(k) for k in ("spark.sql.cbo.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.cbo.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def plan():
            a, b = tables_of()
            df = a.filter("g = 7").join(b, "k")
            assert df.count() == 40
            return df._jdf.queryExecution().executedPlan().toString()

        def tables_of():
            return spark.table("stat_big"), spark.table("stat_other")

        tables.register(spark, "stat_big", big)
        tables.register(spark, "stat_other", other)
        assert "SortMergeJoin" in plan()
        tables.analyze(spark, "stat_big")
        tables.analyze(spark, "stat_other")
        after = plan()
        assert "BroadcastHashJoin" in after and "SortMergeJoin" not in after
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = {r["column"]: r for r in tables.statistics(spark, ["stat_big"]).collect()}
    assert rows["g"]["rows"] == 20_000 and rows["g"]["nulls"] == 0 and (rows["g"]["min_value"], rows["g"]["max_value"]) == ("0", "499")
    assert rows["pad"]["min_value"] is None
    spark.sql("DROP TABLE stat_big")
    assert spark.read.parquet(big).count() == 20_000


def _log(spark, hot: int):
    f = Factory()
    for i in range(6):
        f.happy_path(f"t{i}", amount=f"{i}.50")
    for i in range(hot):
        f.event("settled", "hot", i % 7)
    log = f.df(spark)
    return log, projection.project_transactions(log)


def test_history_joins_without_exchange(spark, tmp_root):
    log, txn = _log(spark, 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left, right = tables.history_tables(log, txn, os.path.join(tmp_root, "h"), "hist", 4, slice_events=8)
        out = tables.with_history(left, right)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want, got = {}, {}
    for r in log.collect():
        want.setdefault(r.transaction_id, set()).add((r.occurred_at, r.event_id, r.event_type, r.amount, r.currency))
    for r in rows:
        some = [tuple(e) for e in r.events]
        assert some == sorted(some) and not got.get(r.transaction_id, set()) & set(some)
        got.setdefault(r.transaction_id, set()).update(some)
        assert r.slices == (5 if r.transaction_id == "hot" else 1)
    assert got == want and max(len(r.events) for r in rows) < 40


def test_history_buckets_grow_in_number_only(spark, tmp_root, monkeypatch):
    """A bucket is sorted in one task, so more events make more buckets."""
    from tallyline.plans.catalog import registry

    monkeypatch.setattr(tables, "BUCKET_EVENTS", 100, raising=False)
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    kind = F.element_at(F.array(*map(F.lit, ("view", "purchase", "error", "signup"))), (F.col("id") % 4 + 1).cast("int"))
    (spark.range(1200).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 600).alias("user_id"),
                              kind.alias("event_type"), (F.col("id") / 7).alias("value"))
     .write.parquet(os.path.join(tmp_root, "events.parquet")))
    (spark.range(25).select(F.col("id").alias("n_nationkey"), F.col("id").cast("string").alias("n_name"))
     .write.parquet(os.path.join(tmp_root, "nation.parquet")))
    out = registry()["txn_with_history"](spark, tmp_root)
    name = re.search(r"tallyline_[0-9a-f]{12}_", out._jdf.queryExecution().executedPlan().toString())[0]
    for side, total in (("events", 1200), ("txn", 600)):
        files = [r["count"] for r in spark.table(name + side).groupBy(F.input_file_name()).count().collect()]
        assert len(files) == 12 and sum(files) == total and max(files) < 200, (side, files)
    assert tuple(out.agg(F.count(F.lit(1)), F.sum("event_count"), F.sum("events_here")).first()) == (600, 1200, 1200)
    before = spark.conf.get(tables.MAX_BUCKETS_CONF)
    try:
        spark.conf.set(tables.MAX_BUCKETS_CONF, "7")
        assert [tables.history_buckets(spark, n) for n in (0, 1, 100, 101, 10_000)] == [1, 1, 1, 2, 7]
    finally:
        spark.conf.set(tables.MAX_BUCKETS_CONF, before)


def test_events_without_a_transaction_are_sliced(spark, tmp_root):
    """They join with nothing, and still lie in no single bucket."""
    f = Factory()
    f.happy_path("t0")
    for i in range(200):
        f.event("settled", None, i % 7)
    log = f.df(spark)
    txn = projection.project_transactions(log)
    left, right = tables.history_tables(log, txn, os.path.join(tmp_root, "h"), "hist_null", 4, slice_events=8)
    dealt = {r["slice"]: r["count"] for r in right.filter("transaction_id is null").groupBy("slice").count().collect()}
    assert sum(dealt.values()) == 200 and len(dealt) > 15 and max(dealt.values()) < 30
    got = [(r.transaction_id, r.slices, len(r.events)) for r in tables.with_history(left, right).collect()]
    assert sorted(got, key=str) == [("t0", 1, 3), *[(None, 25, 0)] * 25]


@pytest.mark.parametrize("sort_by,sort_dir", [("initiated_at", "desc"), ("amount", "asc"), ("settled_at", "asc")])
def test_deep_pages_equal_offset_pages(spark, sort_by, sort_dir):
    """Ties and nulls in the sort key; ranges of a few rows."""
    draw = random.Random(3)
    f = Factory()
    for i in range(300):
        f.event("payment_initiated" if i % 9 else "settled", f"t{i:04d}", draw.choice((0, 0, 0, 5, draw.randint(0, 99))), amount=f"{draw.randint(0, 4)}.00")
    txn = projection.transactions(f.df(spark)).withColumn("merchant_name", F.lit("m")).cache()
    for offset in (150, 295):
        want = reports.list_transactions(txn, None, sort_by, sort_dir, 10, offset).collect()
        assert reports.deep_page(txn, offset, 10, None, sort_by, sort_dir, range_rows=20, bounds=6).collect() == want, offset
        low, before, _ = reports.range_before(txn, sort_by, sort_dir, offset, 10, 20, 6)
        assert before <= offset and offset - before <= 20


def test_deep_page_is_filtered_to_its_range(spark):
    """The last sort sees only rows of the page's range."""
    txn = projection.transactions(_log(spark, 3)[0]).withColumn("merchant_name", F.lit("m"))
    wide = txn.drop("transaction_id").crossJoin(spark.range(2000).select(F.col("id").cast("string").alias("transaction_id")))
    wide = wide.withColumn("initiated_at", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(transaction_id as int) % 997, 0)")).cache()
    offset = int(wide.count() * 0.9)
    low, before, high = reports.range_before(wide, "initiated_at", "desc", offset, 50, 500, 8)
    inside = wide.filter(reports.after_row("initiated_at", "desc", *low)).filter(~reports.after_row("initiated_at", "desc", *high))
    assert offset - before <= 500 and inside.count() < 0.2 * wide.count()


def test_multiset_digest(spark):
    rows = [(1, "a", None), (1, "a", None), (2, "b|", "x"), (12, "", "1:a")]
    df = spark.createDataFrame(rows, "k int, v string, w string")
    one = audits.multiset_digest(df).first()
    assert one == audits.multiset_digest(df.repartition(5).orderBy(F.rand(1))).first() and one["rows"] == 4
    others = [rows[1:], [*rows, rows[0]], [(1, "a", "-"), *rows[1:]], [*rows[:3], (1, "2", "1:a")]]
    assert len({tuple(audits.multiset_digest(spark.createDataFrame(o, df.schema)).first()) for o in others} | {tuple(one)}) == 5
    assert tuple(audits.multiset_digest(df.limit(0)).first()) == (0, 0, 0)


def test_running_state_is_kept_in_rocksdb(spark, tmp_root):
    """State in RocksDB with changelogs; a restart goes on with it."""
    from tallyline.streaming.ingest import delivery_file_stream, run_running_state

    log, _ = _log(spark, 5)
    rows, src = log.collect(), os.path.join(tmp_root, "src")
    out, ckpt = os.path.join(tmp_root, "out"), os.path.join(tmp_root, "ckpt")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (rows[::2], rows[1::2] + rows[:3]):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(src)
        state = run_running_state(delivery_file_stream(spark, src, log.schema), out, ckpt)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = projection.rebuild(log)
    cols = sorted(want.columns)
    assert state.select(cols).exceptAll(want.select(cols)).count() == 0 and state.count() == want.count()
    kept = [f for _, _, names in os.walk(os.path.join(ckpt, "state")) for f in names]
    assert any(f.endswith(".changelog") for f in kept) and not any(f.endswith(".delta") for f in kept)
