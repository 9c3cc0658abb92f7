"""Registered queries on feeds, lookups and planted faults.

The planted queries run an audit over the whole tables with known faults put
in, so that an audit that finds nothing cannot pass for one that works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import audits, ingest, reports
from tallyline.plans.catalog import AS_OF, PAGE_LIMIT, SLA_HOURS, Recon, query
from tallyline.plans.extra_queries import STREAM_COLUMNS

FAR_OFFSET = 1_000_000_000   # a page past the end of any table


@query("store_mixed_feeds")
def q_store_mixed_feeds(r: Recon) -> DataFrame:
    """A backfill and two feeds, each numbering its batches from 0, then a
    batch of replays alone that renames merchants. Must equal the rebuild."""
    from tallyline.session import scratch_path
    from tallyline.sources.store import EventStore

    first = r.deliveries.filter(F.col("batch_id") == 0)
    replays = r.deliveries.filter(F.col("batch_id") == 1)
    store = EventStore(r.spark, scratch_path(r.spark, "store-mixed"), buckets=8)
    for part, feed in enumerate(("backfill", "stream-a", "stream-b")):
        store.ingest(first.filter(F.col("event_id") % 3 == part), 0, feed=feed)
    store.ingest(replays.withColumn("merchant_name", F.concat("merchant_name", F.lit(" (new)"))), 1, feed="stream-a")
    store.ingest(first.limit(0), 1, feed="stream-b")
    return store.transactions().join(store.merchants(), "merchant_id").select(*STREAM_COLUMNS, "merchant_name")


@query("ingest_labels_log")
def q_ingest_labels_log(r: Recon) -> DataFrame:
    """C2/C3 against a log that already holds the even events."""
    log = r.raw_log.filter(F.col("event_id") % 2 == 0)
    return ingest.label_deliveries(r.deliveries, log).select("event_id", "batch_id", "pos", "status")


@query("merchants_merge")
def q_merchants_merge(r: Recon) -> DataFrame:
    """C7/F5 over an existing dimension: odd merchants are new, every fourth
    has another name, and one is not delivered at all."""
    kept = r.deliveries.groupBy("merchant_id").agg(F.max("merchant_name").alias("merchant_name")).filter(F.col("merchant_id") % 2 == 0)
    named = F.when(F.col("merchant_id") % 4 == 0, F.concat(F.lit("was "), "merchant_name")).otherwise(F.col("merchant_name"))
    gone = kept.agg((-F.count(F.lit(1))).alias("merchant_id")).select("merchant_id", F.lit("gone").alias("merchant_name"))
    return ingest.merge_merchants(kept.withColumn("merchant_name", named).unionByName(gone), r.deliveries)


def _one_id(r: Recon):
    return r.txn.agg(F.min("transaction_id")).first()[0]


@query("txn_lookup")
def q_txn_lookup(r: Recon) -> DataFrame:
    """One transaction with its rules, from one bucket of the store."""
    from tallyline.functions.rules import Horizon

    return reports.transaction_detail(r.store.lookup(_one_id(r)), Horizon.of(AS_OF, SLA_HOURS).cutoff, merchants=r.merchants)


@query("txn_history_one")
def q_txn_history_one(r: Recon) -> DataFrame:
    """one transaction's events, from one bucket of the log."""
    return r.store.history(_one_id(r)).select("transaction_id", "event_id", "event_type", "amount", "currency", "occurred_at",
                                              F.get_json_object("payload", "$.merchant_name").alias("merchant_name"))


@query("discrepancy_page_meta")
def q_discrepancy_page_meta(r: Recon) -> DataFrame:
    first = reports.discrepancy_page_meta(r.txn, AS_OF, SLA_HOURS, limit=PAGE_LIMIT)
    return first.unionByName(reports.discrepancy_page_meta(r.txn, AS_OF, SLA_HOURS, limit=PAGE_LIMIT, offset=FAR_OFFSET))


@query("txn_page2_by_key")
def q_txn_page2_by_key(r: Recon) -> DataFrame:
    """The second page by the key of the first page's last row."""
    first = reports.list_transactions(r.txn, limit=PAGE_LIMIT, merchants=r.merchants)
    last = first.orderBy(F.col("initiated_at").asc_nulls_first(), "transaction_id").first()
    return reports.list_transactions(r.txn, limit=PAGE_LIMIT, merchants=r.merchants,
                                     after=(last["initiated_at"], last["transaction_id"]))


@query("validate_json")
def q_validate_json(r: Recon) -> DataFrame:
    """A1/B: the wire rows as JSON text, some with a time without a date, a
    number for a name, or broken off, parsed and validated."""
    from tallyline.operators.validate import validate
    from tallyline.schema import WIRE_FIELDS
    from tallyline.sources.driver_tables import CORRUPT_CYCLE, wire_deliveries
    from tallyline.sources.json_events import wire_from_json

    wire = wire_deliveries(r.spark, r.sf_dir)
    k = F.col("pos") % CORRUPT_CYCLE
    time = F.when(k == 18, F.lit("12:30:00")).otherwise(F.col("timestamp"))
    fields = [time.alias(f) if f == "timestamp" else F.col(f) for f in WIRE_FIELDS if f != "merchant_name"]
    text = F.to_json(F.struct(*fields, "merchant_name", F.when(F.size("extra_keys") > 0, F.lit("x")).alias("note")))
    number = F.to_json(F.struct(*fields, F.lit(123).alias("merchant_name")))
    raw = F.when(F.col("pos") % (2 * CORRUPT_CYCLE) == 0, F.lit('{"event_id": ')).when(k == 19, number).otherwise(text)
    return validate(wire_from_json(wire.select("pos", raw.alias("raw_json")), 0)).select(
        "pos", "is_valid", "error_count", "first_error_field", "first_error_code")


@query("audit_constraints_planted")
def q_audit_constraints_planted(r: Recon) -> DataFrame:
    key = F.col("transaction_id")
    bare = key % 83 == 0
    return audits.audit_constraints(r.txn.withColumns({
        "amount": F.when(key % 97 == 0, -F.col("amount") - 1).otherwise(F.col("amount")),
        "settled_event_count": F.when(key % 89 == 0, F.lit(-1)).otherwise(F.col("settled_event_count")),
        **{c: F.when(~bare, F.col(c)) for c in ("initiated_at", "processed_at", "failed_at", "first_settled_at")}}))


@query("audit_orphans_planted")
def q_audit_orphans_planted(r: Recon) -> DataFrame:
    return audits.audit_orphans(r.txn, r.log, r.merchants.filter(F.col("merchant_id") % 5 != 0))


@query("audit_keys_planted")
def q_audit_keys_planted(r: Recon) -> DataFrame:
    moved = r.deliveries.withColumn("transaction_id", F.col("transaction_id") + F.col("batch_id"))
    return audits.audit_keys(moved, r.log.unionAll(r.log.filter(F.col("event_id") % 91 == 0)),
                             r.txn.unionAll(r.txn.filter(F.col("transaction_id") % 79 == 0)))
