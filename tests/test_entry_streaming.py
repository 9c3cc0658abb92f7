from __future__ import annotations

import os
import random

import pytest

import __spark_entry__ as E
from tallyline.operators import projection
from tallyline.sources.store import EventStore
from tallyline.streaming.ingest import delivery_file_stream, run_ingest_stream, run_running_state
from tests.conftest import Factory

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"transaction_id", "discrepancies", "age_hours", "merchant_name"} <= set(df.columns)


def test_every_query_has_oracle():
    from tallyline.plans.catalog import registry
    from tallyline.plans.oracle import oracle_sql

    assert set(registry()) == set(oracle_sql())
    assert set(registry()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["transactions", "discrepancy_counts", "summary_with_totals",
                                  "txn_page2", "profile_matrix", "audit_keys"])
def test_queries_run_on_smoke_data(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0


def _files(spark, tmp_root, f: Factory, n: int, seed: int):
    rows = list(f.rows)
    random.Random(seed).shuffle(rows)
    src = os.path.join(tmp_root, "src")
    schema = f.df(spark).schema
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(src)
    return src, schema


def _fixture():
    f = Factory()
    for i in range(15):
        f.happy_path(f"t{i}")
        if i % 4 == 0:
            f.event("settled", f"t{i}", 240)
    f.rows += [f.rows[k] for k in range(0, len(f.rows), 6)]  # replays
    return f


@pytest.mark.parametrize("seed", [3, 11])
def test_stream_equals_rebuild(spark, tmp_root, seed):
    f = _fixture()
    src, schema = _files(spark, tmp_root, f, 3, seed)
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=4)
    run_ingest_stream(spark, delivery_file_stream(spark, src, schema), store, os.path.join(tmp_root, "ckpt"))
    rebuilt = projection.rebuild(f.df(spark))
    cols = sorted(rebuilt.columns)
    assert store.transactions().select(cols).exceptAll(rebuilt.select(cols)).count() == 0
    assert rebuilt.select(cols).exceptAll(store.transactions().select(cols)).count() == 0


def test_running_state_equals_rebuild(spark, tmp_root):
    f = _fixture()
    src, schema = _files(spark, tmp_root, f, 3, 5)
    state = run_running_state(delivery_file_stream(spark, src, schema),
                              os.path.join(tmp_root, "state"), os.path.join(tmp_root, "ckpt"))
    rebuilt = projection.rebuild(f.df(spark))
    cols = sorted(rebuilt.columns)
    assert state.select(cols).exceptAll(rebuilt.select(cols)).count() == 0
    assert state.count() == rebuilt.count()


def test_stream_resumes_from_checkpoint(spark, tmp_root):
    f = _fixture()
    rows = list(f.rows)
    schema = f.df(spark).schema
    src, ckpt = os.path.join(tmp_root, "src"), os.path.join(tmp_root, "ckpt")
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=4)
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], schema).coalesce(1).write.mode("append").parquet(src)
    run_ingest_stream(spark, delivery_file_stream(spark, src, schema), store, ckpt)
    first = store.log().count()
    spark.createDataFrame(rows[half:], schema).coalesce(1).write.mode("append").parquet(src)
    q = run_ingest_stream(spark, delivery_file_stream(spark, src, schema), store, ckpt)
    assert q.lastProgress is None or q.lastProgress["numInputRows"] <= len(rows) - half
    assert store.log().count() > first
    rebuilt = projection.rebuild(f.df(spark))
    cols = sorted(rebuilt.columns)
    assert store.transactions().select(cols).exceptAll(rebuilt.select(cols)).count() == 0


def test_wire_json_stream_validates_and_quarantines(spark, tmp_root):
    import json

    from tallyline.streaming.ingest import json_lines_stream

    good = {"event_id": "00000000-0000-4000-8000-000000000001", "event_type": "payment_initiated",
            "transaction_id": "00000000-0000-4000-9000-000000000001", "merchant_id": "m1",
            "merchant_name": "One", "amount": "10.00", "currency": "INR", "timestamp": "2026-01-08T12:00:00"}
    bad = dict(good, event_id="nope")
    src = os.path.join(tmp_root, "json")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in (good, bad, good)) + "\n")
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    run_ingest_stream(spark, json_lines_stream(spark, src), store, os.path.join(tmp_root, "ckpt"), wire=True)
    assert store.log().count() == 1
    assert spark.read.parquet(store.quarantine_path).count() == 1
    assert store.transactions().first()["status"] == "pending"
