from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tallyline.operators import audits, ingest, projection
from tallyline.sources.store import EventStore


def _txn(spark, deliveries):
    return {r["transaction_id"]: r for r in projection.rebuild(deliveries).collect()}


def test_replay_is_one_row(spark, factory):
    factory.event("payment_initiated", "t1", 0, event_id="a")
    factory.event("payment_initiated", "t1", 0, event_id="a")
    d = factory.df(spark)
    assert ingest.dedupe_events(d).count() == 1
    assert _txn(spark, d)["t1"]["event_count"] == 1


def test_replayed_settlement_counts_once(spark, factory):
    factory.happy_path("t1")
    for _ in range(10):
        factory.event("settled", "t1", 180, event_id="e000003")
    t = _txn(spark, factory.df(spark))["t1"]
    assert t["settled_event_count"] == 1
    assert t["event_count"] == 3


def test_distinct_settlements_both_count(spark, factory):
    factory.happy_path("t1")
    factory.event("settled", "t1", 200)
    t = _txn(spark, factory.df(spark))["t1"]
    assert t["settled_event_count"] == 2


def test_in_batch_duplicate_labels_in_order(spark, factory):
    factory.event("payment_initiated", "t1", 0, event_id="x")
    factory.event("payment_processed", "t1", 5, event_id="y")
    factory.event("payment_processed", "t1", 5, event_id="y")
    labels = ingest.label_deliveries(factory.df(spark)).orderBy("pos").select("status").collect()
    assert [r[0] for r in labels] == ["ingested", "ingested", "duplicate"]
    totals = ingest.ingest_totals(factory.df(spark)).first()
    assert (totals["received"], totals["ingested"], totals["duplicates"]) == (3, 2, 1)


def test_labels_against_existing_log(spark, factory):
    factory.event("payment_initiated", "t1", 0, event_id="x")
    first = factory.df(spark)
    log = ingest.dedupe_events(first)
    again = first.withColumn("batch_id", F.lit(1))
    assert [r[0] for r in ingest.label_deliveries(again, log).select("status").collect()] == ["duplicate"]
    assert ingest.dedupe_events(again, log).count() == 0


def test_first_delivery_wins(spark, factory):
    factory.event("settled", "t1", 10, event_id="x", amount="1.00", batch_id=1)
    factory.event("settled", "t1", 10, event_id="x", amount="2.00", batch_id=0)
    row = ingest.dedupe_events(factory.df(spark)).first()
    assert str(row["amount"]) == "2.00" and row["batch_id"] == 0


def test_store_replay_leaves_state_identical(spark, factory, tmp_root):
    for i in range(5):
        factory.happy_path(f"t{i}")
    d = factory.df(spark)
    store = EventStore(spark, tmp_root, buckets=4)
    first = store.ingest(d, 0)
    assert first == {"received": 15, "ingested": 15, "duplicates": 0}
    before = audits.fingerprint(store.transactions()).first()
    second = store.ingest(d, 1)
    assert second == {"received": 15, "ingested": 0, "duplicates": 15}
    assert audits.fingerprint(store.transactions()).first() == before
    assert store.log().count() == 15


def test_retried_batch_overwrites_itself(spark, factory, tmp_root):
    factory.happy_path("t1")
    d = factory.df(spark)
    store = EventStore(spark, tmp_root, buckets=4)
    store.ingest(d, 0)
    again = store.ingest(d, 0)  # the same micro-batch id replayed after a failure
    assert again["ingested"] == 3
    assert store.log().count() == 3
    assert store.transactions().first()["event_count"] == 3


def test_rebuild_equals_incremental_any_order(spark, factory, tmp_root):
    rnd = random.Random(7)
    for i in range(12):
        factory.happy_path(f"t{i}")
        if i % 3 == 0:
            factory.event("settled", f"t{i}", 200)
        if i % 4 == 0:
            factory.event("payment_failed", f"t{i}", 7)
    rows = list(factory.rows)
    rows += [rows[k] for k in range(0, len(rows), 5)]  # replays
    rnd.shuffle(rows)
    store = EventStore(spark, tmp_root, buckets=3)
    chunks = [rows[i::3] for i in range(3)]
    for b, chunk in enumerate(chunks):
        store.ingest(spark.createDataFrame(chunk, factory.df(spark).schema), b)
    incremental = store.transactions()
    rebuilt = projection.rebuild(factory.df(spark))
    cols = sorted(rebuilt.columns)
    assert incremental.select(cols).exceptAll(rebuilt.select(cols)).count() == 0
    assert rebuilt.select(cols).exceptAll(incremental.select(cols)).count() == 0
    assert store.rebuild() == 12
    assert store.transactions().select(cols).exceptAll(rebuilt.select(cols)).count() == 0


def test_merchant_rename_last_write_wins(spark, factory, tmp_root):
    factory.event("payment_initiated", "t1", 0, merchant_name="Old")
    store = EventStore(spark, tmp_root, buckets=2)
    store.ingest(factory.df(spark), 0)
    f2 = type(factory)()
    f2.event("payment_processed", "t1", 5, merchant_name="New")
    store.ingest(f2.df(spark), 1)
    assert store.merchants().first()["merchant_name"] == "New"
    # the last arrival names the merchant, from the names as delivered and as written down
    store.ingest(f2.df(spark), 2)
    assert store.merchants().first()["merchant_name"] == "New"
    store.rebuild()
    assert [tuple(r) for r in store.merchants().collect()] == [("merchant_1", "New")]


def test_truncate_empties_store(spark, factory, tmp_root):
    factory.happy_path("t1")
    store = EventStore(spark, tmp_root, buckets=2)
    store.ingest(factory.df(spark), 0)
    store.truncate()
    assert store.log() is None
    assert store.ingest(factory.df(spark), 0)["ingested"] == 3


def test_single_shuffle_rebuild_matches_and_uses_one_exchange(spark, factory):
    for i in range(6):
        factory.happy_path(f"t{i}")
    factory.rows += factory.rows[:4]  # replays
    d = factory.df(spark)
    exact = projection.rebuild(d)
    fast = projection.rebuild(d, single_shuffle=True)
    cols = sorted(exact.columns)
    assert fast.select(cols).exceptAll(exact.select(cols)).count() == 0
    assert exact.select(cols).exceptAll(fast.select(cols)).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fast._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_stale_stored_status_is_rederived(spark, factory):
    from tallyline.functions.status import with_status

    factory.event("payment_initiated", "t1", 0)
    factory.event("payment_failed", "t1", 5)
    txn = projection.rebuild(factory.df(spark)).withColumn("payment_status", F.lit("processed"))
    assert with_status(txn).first()["payment_status"] == "failed"


def test_log_holds_the_arrival_time(spark, factory, tmp_root):
    from tallyline.operators.reports import arrival_delay

    factory.happy_path("t1")
    d = factory.df(spark)
    store = EventStore(spark, tmp_root, buckets=4)
    store.ingest(d, 0)
    again = store.ingest(d, 1)
    assert again["ingested"] == 0
    delays = arrival_delay(store.log()).select("arrival_delay_seconds").collect()
    assert len(delays) == 3 and all(r[0] > 0 for r in delays)


def test_store_point_lookup_prunes_to_one_bucket(spark, tmp_root):
    from tallyline.sources import driver_tables

    store = EventStore(spark, tmp_root, buckets=4)
    store.load(driver_tables.deliveries(spark, "/root/testdata/sf0.001"))
    some = store.transactions().orderBy("transaction_id").limit(3).collect()
    for row in some:
        hit = store.lookup(row["transaction_id"]).collect()
        assert len(hit) == 1 and hit[0]["event_count"] == row["event_count"]
    plan = store.lookup(some[0]["transaction_id"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(bucket", plan)


def test_readers_take_the_written_projection_only_while_it_is_current(spark, tmp_root):
    from tests.conftest import Factory

    store = EventStore(spark, tmp_root, buckets=2)
    batches = []
    for b in range(4):
        f = Factory()
        for i in range(3):
            f.event("payment_initiated", f"b{b}t{i}", 0, event_id=f"b{b}e{i}i")
            f.event("payment_processed", f"b{b}t{i}", 5, event_id=f"b{b}e{i}p")
        batches.append(f.df(spark))
        store.ingest(batches[-1], b)
    log_rows = store.log().count()
    state = audits.fingerprint(store.transactions()).first()
    assert not store.derived_is_current()
    assert sorted(r[0] for r in store.log().select("batch_id").distinct().collect()) == [0, 1, 2, 3]
    assert store.rebuild() == 12 and store.derived_is_current()
    assert audits.fingerprint(store.transactions()).first() == state
    # a batch of replays, and a retry, change nothing but what readers read from
    assert store.ingest(batches[0], 4)["ingested"] == 0 and not store.derived_is_current()
    assert store.ingest(batches[3], 3)["ingested"] == 6
    assert store.log().count() == log_rows
    assert audits.fingerprint(store.transactions()).first() == state
    assert {r.transaction_id for r in store.touched("direct", 2).collect()} == {"b2t0", "b2t1", "b2t2"}
    assert store.touched("direct", 4).count() == 0
    # a rebuild that broke off leaves no mark: readers group the log
    store.rebuild()
    store._wipe(store.derived_path)
    store._wipe(store.projection_path)
    assert audits.fingerprint(store.transactions()).first() == state
    store.truncate()
    assert store.log() is None


def test_bucket_layout_is_recorded_and_enforced(spark, factory, tmp_root):
    import pytest

    factory.happy_path("t1")
    EventStore(spark, tmp_root, buckets=4).ingest(factory.df(spark), 0)
    assert EventStore(spark, tmp_root).buckets == 4
    with pytest.raises(ValueError):
        EventStore(spark, tmp_root, buckets=8).ingest(factory.df(spark), 1)


def test_merge_merchants_upsert_marks_only_changes(spark, factory):
    current = spark.createDataFrame([("m1", "Old"), ("m2", "Same"), ("m3", "Kept")],
                                    "merchant_id string, merchant_name string")
    factory.event("payment_initiated", "t1", 0, merchant_id="m1", merchant_name="New")
    factory.event("payment_initiated", "t2", 0, merchant_id="m2", merchant_name="Same")
    factory.event("payment_initiated", "t3", 0, merchant_id="m4", merchant_name="Fresh")
    merged = {r["merchant_id"]: (r["merchant_name"], r["changed"])
              for r in ingest.merge_merchants(current, factory.df(spark)).collect()}
    assert merged == {"m1": ("New", True), "m2": ("Same", False), "m3": ("Kept", False), "m4": ("Fresh", True)}


def test_labels_of_hot_events_are_spread_and_others_marked_once(spark, factory, monkeypatch):
    """Hot events are bounded in number; who is hot changes no label."""
    for i in range(30):
        for _ in range(1 + (i % 3) * 20):
            factory.event("settled", f"t{i}", 1, event_id=f"e{i}", batch_id=i % 2)
    rows = factory.df(spark)
    log = ingest.dedupe_events(rows.filter("event_id in ('e1', 'e2', 'e3')"))

    def labels():
        return sorted(map(tuple, ingest.label_deliveries(rows, log).select("batch_id", "pos", "event_id", "status").collect()))

    assert ingest.hot_events(rows).count() == 0
    plain = labels()
    monkeypatch.setattr(ingest, "HOT_COPIES", 15)
    monkeypatch.setattr(ingest, "HOT_EVENTS", 7)
    hot = {r["event_id"] for r in ingest.hot_events(rows).collect()}
    assert len(hot) == 7 and all(int(e[1:]) % 3 == 2 for e in hot)
    assert labels() == plain and len(plain) == rows.count()
    new = [e for _, _, e, status in plain if status == "ingested"]
    assert sorted(new) == sorted(f"e{i}" for i in range(30) if i not in (1, 2, 3))
