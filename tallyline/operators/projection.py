"""The milestone pivot: many log rows -> one transactions row.

Recompute, never increment: every column is an aggregate over the deduplicated
log, so running it once or fifty times gives the same answer, and out-of-order
events converge. All aggregates are algebraic (min/max/count), so Spark combines
them map-side and a hot transaction cannot overload the final reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.status import with_status
from tallyline.operators.ingest import dedupe_events
from tallyline.schema import LOG_COLUMNS

PROJECTION_COLUMNS = (
    "transaction_id", "merchant_id", "amount", "currency",
    "initiated_at", "processed_at", "failed_at", "first_settled_at", "last_settled_at",
    "settled_event_count", "event_count", "first_event_at", "last_event_at",
)


def _when_type(event_type: str) -> Column:
    return F.when(F.col("event_type") == F.lit(event_type), F.col("occurred_at"))


def project_transactions(log: DataFrame) -> DataFrame:
    """Conditional MIN/MAX/COUNT per transaction (NULL = never seen)."""
    settled = F.col("event_type") == F.lit("settled")
    return log.groupBy("transaction_id").agg(
        # Invariants of a transaction; MIN is a deterministic pick (audited by B12).
        F.min("merchant_id").alias("merchant_id"),
        F.min("amount").alias("amount"),
        F.min("currency").alias("currency"),
        F.min(_when_type("payment_initiated")).alias("initiated_at"),
        F.min(_when_type("payment_processed")).alias("processed_at"),
        F.min(_when_type("payment_failed")).alias("failed_at"),
        F.min(_when_type("settled")).alias("first_settled_at"),
        F.max(_when_type("settled")).alias("last_settled_at"),
        F.count_if(settled).alias("settled_event_count"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("occurred_at").alias("first_event_at"),
        F.max("occurred_at").alias("last_event_at"),
    )


def transactions(log: DataFrame) -> DataFrame:
    """Projection plus the derived status axes."""
    return with_status(project_transactions(log))


def rebuild(deliveries: DataFrame, single_shuffle: bool = False) -> DataFrame:
    """The whole projection from deliveries (dedup, pivot, status).

    The default is exact for any input and skew-safe: dedup on event_id and
    pivot on transaction_id, each with map-side combine (two exchanges).

    ``single_shuffle=True`` co-locates each transaction first and dedups inside
    it, so both aggregations reuse one exchange. It is exact only when no
    event_id appears under two transactions (``audits.audit_keys`` returns
    nothing), and it has no map-side combine before that exchange, so a hot
    transaction lands in one task: use it for bounded transactions only.
    """
    if not single_shuffle:
        return transactions(dedupe_events(deliveries))
    payload = [c for c in LOG_COLUMNS if c not in ("event_id", "transaction_id", "batch_id", "pos")]
    log = (deliveries.repartition("transaction_id")
           .groupBy("transaction_id", "event_id")
           .agg(F.min(F.struct("batch_id", "pos", *payload)).alias("_first"))
           .select("transaction_id", "event_id", *[F.col(f"_first.{c}").alias(c) for c in payload]))
    return transactions(log)
