from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tallyline.operators import audits, ingest, profile, projection
from tests.conftest import AS_OF, Factory


def test_audits_find_planted_problems(spark):
    f = Factory()
    f.happy_path("ok")
    f.event("payment_initiated", "conflict", 0, amount="1.00")
    f.event("payment_processed", "conflict", 5, amount="2.00")
    f.event("payment_initiated", "split", 0, event_id="shared")
    f.event("payment_initiated", "other", 0, event_id="shared")
    d = f.df(spark)
    log = ingest.dedupe_events(d)
    txn = projection.transactions(log)
    merchants = ingest.latest_merchant_names(d).filter("merchant_id <> 'merchant_1'")
    assert audits.audit_constraints(txn).count() == 0
    assert audits.audit_orphans(txn, log, merchants).count() > 0
    inv = audits.audit_invariants(log).collect()
    assert [(r["transaction_id"], r["amount_conflict"]) for r in inv] == [("conflict", True)]
    keys = audits.audit_keys(d, log, txn).collect()
    assert [(r["check"], r["key"]) for r in keys] == [("event_in_two_transactions", "shared")]
    bad = txn.withColumn("amount", F.lit(-1).cast("decimal(14,2)"))
    assert audits.audit_constraints(bad).count() == 3


def test_fingerprint_ignores_order_and_partitioning(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    a = audits.fingerprint(df).first()
    b = audits.fingerprint(df.repartition(13).orderBy(F.desc("id"))).first()
    c = audits.fingerprint(df.filter("id > 0")).first()
    assert a == b and a != c


def _brute_shapes(rows):
    by_txn = {}
    for r in sorted(rows, key=lambda r: (r["transaction_id"], r["occurred_at"], r["event_id"])):
        by_txn.setdefault(r["transaction_id"], []).append(r["event_type"])
    return Counter(">".join(v) for v in by_txn.values())


def test_shapes_match_brute_force_when_a_transaction_spans_partitions(spark):
    f = Factory()
    for i in range(30):
        f.happy_path(f"t{i:02d}")
    for k in range(400):  # one hot transaction, spread over many sorted partitions
        f.event("settled" if k % 3 else "payment_processed", "hot", k)
    log = ingest.dedupe_events(f.df(spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = log.orderBy("transaction_id", "occurred_at", "event_id").rdd.glom().map(len).collect()
        assert sum(1 for p in parts if p) > 2
        got = {r["shape"]: r["transactions"] for r in profile.profile_shapes(log).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == dict(_brute_shapes(log.collect()))


def test_profiles_on_small_fixture(spark):
    f = Factory()
    f.happy_path("a")
    f.event("settled", "a", 180, event_id="e000003")  # replay
    f.event("payment_initiated", "b", 0)
    f.event("payment_processed", "b", 5)
    d = f.df(spark)
    txn = projection.rebuild(d)
    lag = profile.profile_lag(txn).first()
    assert lag["settled_after_processing"] == 1 and lag["max_hours"] == round(175 / 60, 6)
    age = profile.profile_unsettled_age(txn, AS_OF).first()
    assert age["never_settled"] == 1
    dup = profile.profile_duplicates(d).collect()
    assert [(r["event_type"], r["duplicates"]) for r in dup] == [("settled", 1)]
    naive = profile.profile_naive_vs_dedup(d, txn).first()
    assert (naive["naive_duplicate_settlements"], naive["dedup_duplicate_settlements"]) == (1, 0)
    m = {r["payment_status"]: r for r in profile.profile_matrix(txn).collect()}
    assert m["processed"]["settled_once"] == 1 and m["processed"]["unsettled"] == 1


def test_shapes_carry_across_arrow_batches(spark):
    f = Factory()
    for i in range(12):
        f.happy_path(f"t{i:02d}")
    for k in range(50):
        f.event("settled" if k % 2 else "payment_processed", "hot", k)
    log = ingest.dedupe_events(f.df(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["shape"]: r["transactions"] for r in profile.profile_shapes(log).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(_brute_shapes(log.collect()))


def test_shape_digests_are_those_of_the_whole_sequences(spark):
    """Digests put together from slices (partitions and Arrow batches) equal the
    polynomial of the whole sequence; equal sequences and no others share one."""
    f = Factory()
    for i in range(20):
        f.happy_path(f"t{i:02d}")
    for k in range(300):
        f.event("settled" if k % 3 else "payment_processed", "hot", k)
    for k in range(300):  # the same events in another order
        f.event("settled" if k % 3 != 1 else "payment_processed", "warm", k)
    log = ingest.dedupe_events(f.df(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r["transaction_id"]: (r["events"], tuple(r["digest"])) for r in profile.shape_digests(log.repartition(8)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lanes = range(len(profile.DIGEST_BASES))
    codes = {r[0]: r[1:] for r in log.select("event_type").distinct().select("event_type", *[
        F.pmod(F.xxhash64("event_type", F.lit(i)), F.lit(profile.DIGEST_PRIME)) for i in lanes]).collect()}
    sequences = {}
    for r in sorted(log.collect(), key=lambda r: (r["transaction_id"], r["occurred_at"], r["event_id"])):
        sequences.setdefault(r["transaction_id"], []).append(r["event_type"])
    for txn, types in sequences.items():
        digest = [0 for _ in lanes]
        for t in types:
            digest = [(d * b + c) % profile.DIGEST_PRIME for d, b, c in zip(digest, profile.DIGEST_BASES, codes[t])]
        assert got[txn] == (len(types), tuple(digest))
    assert len(got) == len(sequences) and len(set(got.values())) == len({tuple(t) for t in sequences.values()})
    assert profile.profile_shapes(log.limit(0)).count() == 0
