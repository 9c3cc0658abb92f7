"""Feeds that share batch numbers, kept quarantines, untouched files, honest reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyline.load import load_file
from tallyline.operators import ingest, profile
from tallyline.operators import validate as V
from tallyline.sources.json_events import read_event_array, read_event_lines
from tallyline.sources.store import EventStore
from tallyline.streaming.ingest import delivery_file_stream, run_ingest_stream
from tests.conftest import Factory
from tests.test_validate import GOOD, _write


def _event(i: int, **kw) -> dict:
    return dict(GOOD, event_id=f"00000000-0000-4000-8000-{i:012x}", transaction_id=f"00000000-0000-4000-9000-{i // 2:012x}", **kw)


def test_feeds_number_their_batches_alone(spark, tmp_root):
    """A backfill and two streams all start at 0; nothing of theirs is lost."""
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    back = Factory()
    for i in range(10):
        back.event("payment_initiated", f"t{i}", i)
    store.ingest(back.df(spark), 0, feed="backfill")
    for k in range(2):
        live = Factory()
        live._n = 100 * (k + 1)
        for i in range(3):
            live.event("payment_processed", f"t{i + k}", 5)
        src = os.path.join(tmp_root, f"in{k}")
        live.df(spark).coalesce(1).write.parquet(src)
        run_ingest_stream(spark, delivery_file_stream(spark, src, spark.read.parquet(src).schema), store,
                          os.path.join(tmp_root, f"checkpoint{k}"))
    assert store.log().count() == 16
    assert store.transactions().count() == 10
    assert store.lookup("t1").first()["event_count"] == 3


def test_a_retry_replaces_the_batch_of_its_own_feed(spark, factory, tmp_root):
    store = EventStore(spark, tmp_root, buckets=2)
    factory.happy_path("t1")
    for feed in ("a", "b", "a"):
        store.ingest(factory.df(spark), 7, feed=feed)
    store.ingest(factory.df(spark))
    got = {r.feed: r.n for r in store.log().groupBy("feed").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 3} and {r.batch_id for r in store.log().collect()} == {7}
    assert store.names().select("feed").distinct().count() == 3
    with pytest.raises(ValueError, match="starts with a letter"):
        store.ingest(factory.df(spark), 0, feed="2024-01-01")


def test_rename_in_a_batch_of_replays_survives(spark, tmp_root):
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    old = _write(tmp_root, "old.json", json.dumps([_event(1)]))
    new = _write(tmp_root, "new.json", json.dumps([_event(1, merchant_name="New")]))
    other = _write(tmp_root, "other.json", json.dumps([_event(2, merchant_id="m2")]))
    load_file(spark, old, store)
    assert load_file(spark, new, store)["ingested"] == 0
    load_file(spark, other, store)
    assert {r.merchant_id: r.merchant_name for r in store.merchants().collect()}["merchant_1"] == "New"


def test_each_load_keeps_its_quarantine(spark, tmp_root):
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    for i in range(2):
        path = _write(tmp_root, f"bad{i}.json", json.dumps([_event(i), dict(_event(9), currency=f"XX{i}")]))
        load_file(spark, path, store, on_error="quarantine")
    assert sorted(r.currency for r in spark.read.parquet(store.quarantine_path).collect()) == ["XX0", "XX1"]


def test_empty_first_batch(spark, factory, tmp_root):
    store = EventStore(spark, tmp_root, buckets=2)
    assert store.ingest(factory.df(spark), 0) == {"received": 0, "ingested": 0, "duplicates": 0}
    factory.happy_path("t1")
    assert store.ingest(factory.df(spark), 1)["ingested"] == 3


def _files(root: str) -> dict[str, float]:
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_only_its_own_partitions(spark, tmp_root):
    first, second = Factory(), Factory()
    for i in range(40):
        first.happy_path(f"t{i}")
    second._n = 1000
    second.event("settled", "t3", 500)
    second.event("payment_initiated", "new", 0)
    store = EventStore(spark, tmp_root, buckets=4)
    store.ingest(first.df(spark), 0)
    store.rebuild()
    before = _files(tmp_root)
    store.ingest(second.df(spark), 1)
    after = _files(tmp_root)
    new = [os.path.relpath(f, tmp_root) for f in after.keys() - before.keys()]
    assert before.items() <= after.items() and new
    assert all(f.startswith(("log/feed=direct/batch_id=1/", "names/feed=direct/batch_id=1/")) for f in new)
    got = {r.transaction_id: r for r in store.transactions().collect()}
    assert len(got) == 41 and got["t3"].settled_event_count == 2 and got["t4"].event_count == 3
    assert store.lookup("t3").first()["settled_event_count"] == 2
    store.rebuild()
    assert {r.transaction_id: r for r in store.transactions().collect()} == got
    assert store.lookup("t3").first()["settled_event_count"] == 2
    assert [r.event_type for r in store.history("t3").collect()][-1] == "settled"


def test_totals_are_counted_by_the_writing_jobs(spark, factory, tmp_root, monkeypatch):
    """Received, ingested and rejected come without a job of their own."""
    for i in range(20):
        factory.happy_path(f"t{i}")
    factory.rows += factory.rows[:7]
    store = EventStore(spark, tmp_root, buckets=2)
    store._ensure_layout()
    batch = factory.df(spark)

    def refuse(self, *a):
        raise AssertionError("a job that only counts")

    for action in ("count", "agg"):
        monkeypatch.setattr(type(batch), action, refuse)
    assert store.ingest(batch, 0) == {"received": 67, "ingested": 60, "duplicates": 7}
    assert store.quarantine(batch.drop("batch_id"), "direct", 0) == 67
    assert store.quarantine(batch.drop("batch_id").limit(0), "direct", 1) == 0


def test_payload_holds_the_whole_event(spark, factory, tmp_root):
    factory.event("settled", "t1", 1, merchant_name="Shop", amount="2.50")
    store = EventStore(spark, tmp_root, buckets=2)
    store.ingest(factory.df(spark), 0)
    payload = json.loads(store.log().first()["payload"])
    assert payload["merchant_name"] == "Shop" and payload["timestamp"].startswith("2026-01-08T12:01") and payload["amount"] == 2.5


def test_readers_see_what_other_writers_add(spark, tmp_root):
    reader = EventStore(spark, tmp_root, buckets=2)
    for i in range(3):
        f = Factory()
        f._n = 10 * i
        f.event("payment_initiated", f"t{i}", i)
        EventStore(spark, tmp_root, buckets=2).ingest(f.df(spark), i)
        assert reader.transactions().count() == reader.log().count() == i + 1


def test_a_broken_store_is_not_an_empty_one(spark, factory, tmp_root):
    factory.happy_path("t1")
    store = EventStore(spark, tmp_root, buckets=1)
    store.ingest(factory.df(spark), 0)
    for path in _files(store.log_path):
        with open(path, "w") as fh:
            fh.write("not parquet")
    with pytest.raises(Exception):
        store.ingest(factory.df(spark), 1)


def test_a_full_load_names_its_source(spark, factory, tmp_root):
    factory.happy_path("t1")
    store = EventStore(spark, tmp_root, buckets=2)
    store.load(factory.df(spark), "a: 3 events")
    assert store.is_complete() and store.is_complete("a: 3 events") and not store.is_complete("a: 4 events")
    other = Factory()
    other._n = 50
    other.event("settled", "t1", 600)
    store.ingest(other.df(spark), 0, feed="other")   # the load's own batch 0 stays
    assert store.log().count() == 4 and store.lookup("t1").first()["settled_event_count"] == 2


@pytest.mark.parametrize("text", ["[{]", '[{"a": 1}', "nonsense", '{"a": '])
def test_a_broken_document_fails_the_read(spark, tmp_root, text):
    with pytest.raises(Exception, match="not a JSON document"):
        read_event_array(spark, _write(tmp_root, "x.json", text)).collect()


@pytest.mark.parametrize("field,value,code", [
    ("timestamp", "12:30:00", "datetime_parsing"), ("timestamp", "T12:30", "datetime_parsing"),
    ("timestamp", "2026", "datetime_parsing"), ("timestamp", "2026-1-8", "datetime_parsing"),
    ("timestamp", 1767873600, "string_type"), ("timestamp", "2026-01-08", None), ("timestamp", "2026-01-08 10:00", None),
    ("merchant_id", 123, "string_type"), ("merchant_name", {"a": 1}, "string_type"), ("currency", ["inr"], "string_type"),
    ("amount", 12.5, None), ("amount", 12, None), ("amount", True, "decimal_type"), ("merchant_name", None, "missing"),
])
def test_types_and_times_are_strict(spark, tmp_root, field, value, code):
    path = _write(tmp_root, "x.json", json.dumps(dict(GOOD, **{field: value})))
    row = V.validate(read_event_array(spark, path)).first()
    assert row["first_error_code"] == code and (code is None or row["first_error_field"] == field)


def test_positions_follow_the_files(spark, tmp_root):
    """Numbers run through all files in order, however they are split, and a
    chunked load over several files ends with exact totals."""
    folder = os.path.join(tmp_root, "lines")
    os.makedirs(folder)
    for k in range(3):
        _write(folder, f"f{k}.jsonl", "\n\n".join(json.dumps(_event(5 * k + i)) for i in range(5)))
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r.pos, int(r.event_id[-12:], 16)) for r in read_event_lines(spark, folder).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [(i, i) for i in range(15)]
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    assert load_file(spark, folder, store, chunk_size=1000, lines=True) == {"received": 15, "ingested": 15, "duplicates": 0}
    arrays = os.path.join(tmp_root, "arrays")
    os.makedirs(arrays)
    for k in range(2):
        _write(arrays, f"f{k}.json", json.dumps([_event(5 * k + i) for i in range(5)]))
    assert sorted((r.pos, int(r.event_id[-12:], 16)) for r in read_event_array(spark, arrays).collect()) == [(i, i) for i in range(10)]


def test_labels_against_a_log_with_a_hot_event(spark):
    f = Factory()
    for i in range(50):
        f.event("settled", "t", i, event_id="hot")
        f.event("settled", "t", i, event_id=f"e{i}")
    d = f.df(spark)
    log = ingest.dedupe_events(d).filter("event_id in ('e1', 'e2')")
    got = {(r.event_id, r.pos): r.status for r in ingest.label_deliveries(d, log).collect()}
    assert len(got) == 100 and got["hot", 0] == "ingested" and got["e1", 3] == "duplicate"
    assert sum(v == "ingested" for v in got.values()) == 49


def test_percentiles_are_exact(spark):
    values = [((i * 7919) % 1009) ** 2 for i in range(1009)] + [5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v long")
    shares = {"a": 0.5, "b": 0.99, "c": 1.0, "d": 0.0001}
    ranked = sorted(values)
    want = tuple(ranked[max(1, -int(-s * len(ranked) // 1)) - 1] for s in shares.values())
    for step in (1, 1000, 10**9):
        assert tuple(profile.exact_percentiles(df, "v", shares, step).first()) == want
    assert tuple(profile.exact_percentiles(df.limit(0), "v", shares, 10).first()) == (None,) * 4


def test_status_filters_reach_the_scan(spark, factory, tmp_root):
    from tallyline.operators.reports import TxnFilters, list_transactions

    factory.happy_path("t1")
    factory.event("payment_processed", "t2", 1)
    store = EventStore(spark, tmp_root, buckets=1)
    store.load(factory.df(spark))
    for status, tests in (("processed", 3), ("settled", 1), ("pending", 3)):
        df = list_transactions(store.transactions().withColumn("merchant_name", F.lit("x")), TxnFilters(status=status), limit=None)
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters"):].split("]")[0]
        assert pushed.count("Null(") == tests, pushed
        assert df.count() == {"processed": 1, "settled": 1, "pending": 0}[status]


def test_no_local_scratch_off_a_local_master(monkeypatch):
    from tallyline import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake())


def test_session_starts_without_preset_settings(tmp_path):
    """Without a checkpoint setting (an empty conf folder) a local session gets
    a folder of its own; a given setting is kept."""
    conf = tmp_path / "conf"
    conf.mkdir()
    code = ("import sys; from pyspark.sql import SparkSession; from tallyline.session import configure, scratch_path\n"
            "b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n"
            "b = b.config('spark.checkpoint.dir', sys.argv[1]) if len(sys.argv) > 1 else b\n"
            "s = configure(b.getOrCreate()); p = scratch_path(s, 'x'); s.range(3).write.parquet(p)\n"
            "print('ROWS', s.read.parquet(p).count(), p)")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(conf), "PYTHONPATH": os.pathsep.join([here, *sys.path])}
    for given in ([], [str(tmp_path / "ckpt")]):
        done = subprocess.run([sys.executable, "-c", code, *given], env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and "ROWS 3" in done.stdout, done.stderr[-2000:]
        assert not given or given[0] in done.stdout
