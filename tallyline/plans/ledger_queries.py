"""Registered queries on loads in chunks, statistics, joined histories, deep
pages and state digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import audits, ingest, projection, reports
from tallyline.plans.catalog import PAGE_LIMIT, Recon, query
from tallyline.sources.driver_tables import REPLAY_EVERY

LOAD_FILES, FILES_PER_CHUNK, FIRST_CHUNKS = 6, 2, 2
DEEP_SHARE = 0.9        # of all rows that come before the deep page
DEEP_RANGE = 1_000      # rows the deep page may sort besides its own
STATISTICS_COLUMNS = ("transaction_id", "merchant_id", "amount", "initiated_at", "processed_at", "failed_at",
                      "first_settled_at", "settled_event_count", "event_count", "last_event_at")
STATE_COLUMNS = ["transaction_id", "merchant_id", "amount", "currency", "settled_event_count", "event_count"]


def wire_json(r: Recon) -> DataFrame:
    """The wire rows as JSON text (value), every fiftieth delivered twice."""
    from tallyline.schema import WIRE_FIELDS
    from tallyline.sources.driver_tables import wire_deliveries

    wire = wire_deliveries(r.spark, r.sf_dir)
    text = F.to_json(F.struct(*WIRE_FIELDS, F.when(F.size("extra_keys") > 0, F.lit("x")).alias("note")))
    copies = F.when(F.col("pos") % REPLAY_EVERY == 0, 2).otherwise(1)
    return wire.select("pos", text.alias("value"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


@query("load_resumed")
def q_load_resumed(r: Recon) -> DataFrame:
    """A5: a folder loaded in chunks, broken off after the second and taken up
    again; the totals of all chunks and what the store then holds."""
    from tallyline.load import load_chunks
    from tallyline.session import scratch_path
    from tallyline.sources.store import EventStore

    base = scratch_path(r.spark, "load-resumed")
    (wire_json(r).repartition(LOAD_FILES, F.xxhash64("pos", "copy")).select("value")
     .write.mode("overwrite").text(f"{base}/wire"))
    store = EventStore(r.spark, f"{base}/store", buckets=4)
    for most in (FIRST_CHUNKS, None):
        load_chunks(r.spark, f"{base}/wire", store, "wire", FILES_PER_CHUNK, "quarantine", most_chunks=most)
    held = store.transactions().agg(F.count(F.lit(1)).alias("transactions"), F.sum("event_count").alias("events"))
    return store.chunk_totals("load:wire").crossJoin(held)   # one row each


@query("table_statistics")
def q_table_statistics(r: Recon) -> DataFrame:
    """The optimiser's statistics of the stored projection."""
    from tallyline.sources import tables

    name = f"tallyline_{r.store.root.rsplit('-', 1)[-1]}_transactions"
    tables.register(r.spark, name, r.store.projection_path)
    tables.analyze(r.spark, name)
    known = tables.statistics(r.spark, [name]).filter(F.col("column").isin(*STATISTICS_COLUMNS))
    number = lambda c: F.when(~F.col("type").startswith("timestamp"), F.col(c).cast("decimal(38,2)"))
    time = lambda c: F.when(F.col("type").startswith("timestamp"), F.col(c).cast("timestamp_ntz"))
    return known.select("column", "rows", "nulls", number("min_value").alias("min_number"), number("max_value").alias("max_number"),
                        time("min_value").alias("min_time"), time("max_value").alias("max_time"))


@query("txn_with_history")
def q_txn_with_history(r: Recon) -> DataFrame:
    """every transaction with its events, from bucketed tables."""
    from tallyline.session import scratch_path
    from tallyline.sources import tables

    path = scratch_path(r.spark, "history")
    name = f"tallyline_{path.rsplit('-', 1)[-1]}"
    txn, events = tables.history_tables(r.log, r.txn, path, name, tables.history_buckets(r.spark, r.log.count()))
    event = lambda e: F.concat_ws(" ", e["event_id"], e["event_type"], e["amount"], F.date_format(e["occurred_at"], "yyyy-MM-dd HH:mm:ss"))
    return tables.with_history(txn, events).select(
        "transaction_id", "status", "slice", "slices", "event_count", F.size("events").alias("events_here"),
        F.array_join(F.transform("events", event), "; ").alias("history"))


@query("txn_page_deep")
def q_txn_page_deep(r: Recon) -> DataFrame:
    """The page that starts behind nine tenths of all transactions."""
    offset = int(r.txn.count() * DEEP_SHARE)
    return reports.deep_page(r.txn, offset, PAGE_LIMIT, merchants=r.merchants, range_rows=DEEP_RANGE)


@query("state_fingerprint")
def q_state_fingerprint(r: Recon) -> DataFrame:
    """C11: digests of the projection from the first deliveries, with all
    replays, and with every delivery a second time in another order."""
    again = r.deliveries.withColumn("batch_id", F.col("batch_id") + 2).withColumn("pos", -F.col("pos"))
    feeds = (("first", r.deliveries.filter(F.col("batch_id") == 0)), ("replayed", r.deliveries), ("again", r.deliveries.unionByName(again)))
    out = None
    for name, feed in feeds:
        state = projection.project_transactions(ingest.dedupe_events(feed))
        row = audits.multiset_digest(state, STATE_COLUMNS).select(F.lit(name).alias("state"), "rows", "high_sum", "low_sum")
        out = row if out is None else out.unionByName(row)
    return out
