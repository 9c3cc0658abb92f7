"""Idempotent ingest: dedup by event_id, per-delivery labels, totals, merchants.

Every operator is a pure ``DataFrame -> DataFrame``. Deduplication and labels
use partial (map-side) aggregation keyed by ``event_id``, so an event replayed
millions of times collapses before the shuffle instead of landing in one task.
The existing log is probed with a semi join built from the batch's keys, so for
a micro-batch the unbounded log is scanned (event_id column only) but not
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.schema import LOG_COLUMNS


# Parts that the copies of a hot event are dealt into when they are labelled.
LABEL_SALTS = 16
# Hot are at most so many events, those delivered most often. Any other event holds
# less than 1 in HOT_EVENTS of all deliveries, so its copies fit one task.
HOT_EVENTS = 1024
HOT_COPIES = 1000
LEAST_LONG = -2**63
# A probe whose keys are too many to broadcast filters the log by their Bloom filter
# first, up to this size of keys (the planner's own bound is 10 MB).
PROBE_SETTINGS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(8 * 4_000_000),
}


def arrival_order() -> Column:
    """Total arrival order of deliveries: batch, then position in the batch."""
    return F.struct(F.col("batch_id"), F.col("pos"))


def known_event_ids(deliveries: DataFrame, log: DataFrame | None, keys: DataFrame | None = None) -> DataFrame | None:
    """Distinct event_ids of ``deliveries`` that the stored log already holds.

    Written as ``log SEMI JOIN batch_keys`` so the build side is the batch:
    when the batch's keys are small (static statistics or AQE's runtime size)
    they are broadcast and the log is streamed without a shuffle; a large
    backfill falls back to a sort-merge join on the event_id column only.
    ``keys`` are those of ``probe_keys``, if the caller has persisted them: the
    log's rows then pass a Bloom filter of them before that join's shuffle.
    """
    if log is None:
        return None
    keys = deliveries.select("event_id").distinct() if keys is None else some_keys(keys)
    return log.select("event_id").join(keys, "event_id", "left_semi").distinct()


def probe_keys(deliveries: DataFrame) -> DataFrame:
    """The distinct event_ids of a batch, to be persisted by the caller."""
    return deliveries.select("event_id").distinct()


def some_keys(keys: DataFrame) -> DataFrame:
    """All of ``keys`` behind a comparison that every id passes: the planner makes
    Bloom filters only of a side that a predicate may have narrowed, and does not
    know that a batch is narrow beside the log."""
    return keys.filter(F.xxhash64("event_id") >= F.lit(LEAST_LONG))


def dedupe_events(deliveries: DataFrame, log: DataFrame | None = None, keep: tuple[str, ...] = (),
                  keys: DataFrame | None = None) -> DataFrame:
    """One row per new event_id; the first delivery by arrival order wins.
    ``keep`` names further columns of that delivery, ``keys`` as for
    ``known_event_ids``."""
    payload = [c for c in LOG_COLUMNS if c not in ("event_id", "batch_id", "pos")]
    payload += keep
    firsts = (deliveries.groupBy("event_id")
              .agg(F.min(F.struct("batch_id", "pos", *payload)).alias("_first"))
              .select("event_id", *[F.col(f"_first.{c}").alias(c) for c in ("batch_id", "pos", *payload)]))
    known = known_event_ids(deliveries, log, keys)
    if known is not None:
        firsts = firsts.join(known, "event_id", "left_anti")
    return firsts.select(*LOG_COLUMNS, *keep)


def hot_events(deliveries: DataFrame) -> DataFrame:
    """(event_id, _hot) of the events delivered most often: at most ``HOT_EVENTS``
    rows whatever the input, so they are broadcast. They decide how rows are
    spread over tasks and no result."""
    return F.broadcast(
        deliveries.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_COPIES)
        .orderBy(F.col("_n").desc(), "event_id").limit(HOT_EVENTS).select("event_id", F.lit(True).alias("_hot")))


def label_deliveries(deliveries: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Label every delivered position ``ingested`` or ``duplicate``.

    The first delivery of an event_id not already in the log is ``ingested``;
    later copies in the same or later batches, and anything the log holds, are
    ``duplicate``.
    """
    # Only events delivered more than once, or held by the log, need a look at
    # their other copies. Those few are matched against the deliveries. The copies
    # of a hot event carry a salt and stay spread over the tasks; its mark is
    # there once a salt, every other mark once.
    marks = (deliveries.groupBy("event_id").agg(F.min(arrival_order()).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > 1).select("event_id", "_first"))
    hot = hot_events(deliveries)
    known = known_event_ids(deliveries, log)
    if known is not None:
        marks = (marks.join(known.withColumn("_in_log", F.lit(True)), "event_id", "full_outer")
                 .withColumn("_first", F.when(F.col("_in_log").isNull(), F.col("_first"))))
    marks = marks.select("event_id", "_first", F.lit(True).alias("_marked"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("batch_id", "pos"), F.lit(LABEL_SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = marks.join(hot, "event_id", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    is_new = F.col("_marked").isNull() | (F.col("_first").isNotNull() & (arrival_order() == F.col("_first")))
    return (deliveries.join(hot, "event_id", "left").withColumn("_salt", salt)
            .join(spread, ["event_id", "_salt"], "left")
            .withColumn("status", F.when(is_new, F.lit("ingested")).otherwise(F.lit("duplicate")))
            .drop("_first", "_marked", "_salt", "_hot")
            .select(*deliveries.columns, "status"))


def ingest_totals(deliveries: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """C4: received / ingested / duplicates without materialising labels."""
    received = deliveries.agg(F.count(F.lit(1)).alias("received"))
    ingested = dedupe_events(deliveries, log).agg(F.count(F.lit(1)).alias("ingested"))
    return (received.crossJoin(ingested)
            .withColumn("duplicates", F.col("received") - F.col("ingested")))


def latest_merchant_names(deliveries: DataFrame) -> DataFrame:
    """One name per merchant_id, the last one delivered (by arrival order)."""
    return (deliveries.groupBy("merchant_id")
            .agg(F.max_by("merchant_name", arrival_order()).alias("merchant_name")))


def merge_merchants(current: DataFrame | None, deliveries: DataFrame) -> DataFrame:
    """Upsert the dimension; names from the newer deliveries win.

    Returns ``merchant_id, merchant_name, changed`` where ``changed`` marks the
    rows whose name is new or different (the only rows worth writing).
    """
    incoming = latest_merchant_names(deliveries).withColumnRenamed("merchant_name", "_new")
    if current is None:
        return incoming.select("merchant_id", F.col("_new").alias("merchant_name"),
                               F.lit(True).alias("changed"))
    merged = current.select("merchant_id", F.col("merchant_name").alias("_old")).join(
        incoming, "merchant_id", "full_outer")
    return merged.select(
        "merchant_id",
        F.coalesce("_new", "_old").alias("merchant_name"),
        (F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_old") != F.col("_new")))).alias("changed"),
    )
