"""Registered queries for audits, profiles, validation and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import audits, profile
from tallyline.operators.projection import PROJECTION_COLUMNS
from tallyline.plans.catalog import AS_OF, Recon, query

# ---------------------------------------------------------------------------
# Audits (B10-B13)
# ---------------------------------------------------------------------------


@query("audit_constraints")
def q_audit_constraints(r: Recon) -> DataFrame:
    return audits.audit_constraints(r.txn)


@query("audit_orphans")
def q_audit_orphans(r: Recon) -> DataFrame:
    return audits.audit_orphans(r.txn, r.log, r.merchants)


@query("audit_invariants")
def q_audit_invariants(r: Recon) -> DataFrame:
    return audits.audit_invariants(r.log)


@query("audit_keys")
def q_audit_keys(r: Recon) -> DataFrame:
    return audits.audit_keys(r.deliveries, r.log, r.txn)


# ---------------------------------------------------------------------------
# Profiles (M1-M7)
# ---------------------------------------------------------------------------


@query("profile_shapes")
def q_profile_shapes(r: Recon) -> DataFrame:
    return profile.profile_shapes(r.log)


@query("profile_matrix")
def q_profile_matrix(r: Recon) -> DataFrame:
    return profile.profile_matrix(r.txn)


@query("profile_lag")
def q_profile_lag(r: Recon) -> DataFrame:
    return profile.profile_lag(r.txn)


@query("profile_unsettled_age")
def q_profile_unsettled_age(r: Recon) -> DataFrame:
    return profile.profile_unsettled_age(r.txn, AS_OF)


@query("profile_duplicates")
def q_profile_duplicates(r: Recon) -> DataFrame:
    return profile.profile_duplicates(r.deliveries)


@query("profile_naive_vs_dedup")
def q_profile_naive_vs_dedup(r: Recon) -> DataFrame:
    return profile.profile_naive_vs_dedup(r.deliveries, r.txn)


@query("profile_ratio")
def q_profile_ratio(r: Recon) -> DataFrame:
    return profile.profile_ratio(r.txn)


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------


@query("validate_errors")
def q_validate_errors(r: Recon) -> DataFrame:
    from tallyline.operators.validate import validate
    from tallyline.sources.driver_tables import wire_deliveries

    v = validate(wire_deliveries(r.spark, r.sf_dir))
    return v.select("pos", "is_valid", "error_count", "first_error_field", "first_error_code",
                    F.col("v_event_id").alias("event_id"), F.col("v_transaction_id").alias("transaction_id"),
                    F.col("v_amount").alias("amount"), F.col("v_currency").alias("currency"),
                    F.col("v_occurred_at").alias("occurred_at"))


# ---------------------------------------------------------------------------
# Streaming (P1-P8): results must equal the batch rebuild (``transactions``)
# ---------------------------------------------------------------------------
STREAM_BATCHES = 3   # micro-batches the source files are drained in
STREAM_COLUMNS = (*PROJECTION_COLUMNS, "payment_status", "settlement_status", "status")


def write_delivery_files(deliveries: DataFrame, path: str) -> int:
    """Write deliveries as Parquet files hashed on (event_id, copy), so copies
    of one event land in different files and hence different micro-batches.
    The number of partitions is explicit (never merged by AQE): at least one
    file for each micro-batch. Returns the number of files written."""
    parts = max(STREAM_BATCHES, int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (deliveries.withColumn("pos", F.col("pos") * 2 + F.col("batch_id"))
     .repartition(parts, F.xxhash64("event_id", "batch_id"))
     .write.mode("overwrite").parquet(path))
    return len(deliveries.sparkSession.read.parquet(path).inputFiles())


def _stream_setup(r: Recon, name: str):
    from tallyline.session import scratch_path
    from tallyline.streaming.ingest import delivery_file_stream

    base = scratch_path(r.spark, name)
    src = f"{base}/source"
    files = write_delivery_files(r.deliveries, src)
    schema = r.spark.read.parquet(src).schema
    per_trigger = max(1, -(-files // STREAM_BATCHES))
    return base, delivery_file_stream(r.spark, src, schema, files_per_trigger=per_trigger)


@query("stream_transactions")
def q_stream_transactions(r: Recon) -> DataFrame:
    from tallyline.sources.store import EventStore
    from tallyline.streaming.ingest import run_ingest_stream

    base, source = _stream_setup(r, "stream-ingest")
    store = EventStore(r.spark, f"{base}/store", buckets=16)
    run_ingest_stream(r.spark, source, store, f"{base}/checkpoint")
    return store.transactions().select(*STREAM_COLUMNS)


@query("stream_running_state")
def q_stream_running_state(r: Recon) -> DataFrame:
    from tallyline.streaming.ingest import run_running_state

    base, source = _stream_setup(r, "stream-state")
    state = run_running_state(source, f"{base}/state", f"{base}/checkpoint")
    return state.select(*STREAM_COLUMNS)


@query("store_incremental")
def q_store_incremental(r: Recon) -> DataFrame:
    """Two batches of originals (the second adds to transactions of
    the first), then the replays, into a fresh store; the projection written and
    read back. Must equal the pivot of the deliveries."""
    from tallyline.session import scratch_path
    from tallyline.sources.store import EventStore

    store = EventStore(r.spark, scratch_path(r.spark, "store-incremental"), buckets=8)
    original = F.col("batch_id") == 0
    for batch, part in enumerate((original & (F.col("event_id") % 2 == 0), original & (F.col("event_id") % 2 == 1), ~original)):
        store.ingest(r.deliveries.filter(part), batch)
    store.rebuild()
    return store.transactions().select(*STREAM_COLUMNS)
