"""Schemas, enumerations and constants shared by every layer."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced (wire format,
# status vocabulary, rule names and their explanation texts, defaults).
# ---------------------------------------------------------------------------
EVENT_TYPES = ("payment_initiated", "payment_processed", "payment_failed", "settled")
PAYMENT_STATUSES = ("pending", "processed", "failed")
SETTLEMENT_STATUSES = ("unsettled", "settled")
FLAT_STATUSES = ("pending", "processed", "failed", "settled")
INGEST_OUTCOMES = ("ingested", "duplicate")
RULE_NAMES = (
    "processed_never_settled",
    "settled_despite_failure",
    "duplicate_settlement",
    "stuck_pending",
    "settled_without_processing",
)
RULE_EXPLANATIONS = {
    "processed_never_settled": "Payment was processed but has not settled within the SLA window.",
    "settled_despite_failure": "Settlement was recorded for a payment that failed.",
    "duplicate_settlement": "Transaction was settled more than once by distinct events.",
    "stuck_pending": "Payment was initiated but never processed, failed or settled.",
    "settled_without_processing": "Settlement was recorded without any preceding payment processing.",
}
WIRE_FIELDS = ("event_id", "event_type", "transaction_id", "merchant_id",
               "merchant_name", "amount", "currency", "timestamp")
DEFAULT_SLA_HOURS = 24
MAX_SLA_HOURS = 8760
DEFAULT_PAGE_SIZE = 50
MERCHANT_ID_MAX_LEN = 64
MERCHANT_NAME_MAX_LEN = 255
AMOUNT_MAX_DIGITS = 14
AMOUNT_SCALE = 2

# The fixed transaction projection served by list and detail views.
TXN_VIEW_COLUMNS = (
    "transaction_id", "merchant_id", "merchant_name", "amount", "currency",
    "status", "payment_status", "settlement_status",
    "initiated_at", "processed_at", "failed_at",
    "first_settled_at", "last_settled_at",
    "event_count", "settled_event_count", "last_event_at",
)

# Whitelisted sort keys (public name -> projection column).
SORT_KEYS = {
    "initiated_at": "initiated_at",
    "processed_at": "processed_at",
    "settled_at": "first_settled_at",
    "last_event_at": "last_event_at",
    "amount": "amount",
}

# Whitelisted summary dimensions, in their canonical order.
SUMMARY_DIMENSIONS = ("merchant", "date", "status", "payment_status", "settlement_status")
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(14, 2)
# Sums and differences of sums are reported in one declared type; 38 digits
# cannot overflow for any realistic number of 14-digit amounts.
MONEY_SUM = T.DecimalType(38, 2)

# A delivery as received on the wire: every field is text so that validation
# sees exactly what was sent (a numeric reader would round 1.239 to 1.24).
WIRE_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in WIRE_FIELDS])

# Columns of a validated delivery. ``batch_id`` and ``pos`` give the arrival
# order that decides which copy of a replayed event is "first".
DELIVERY_COLUMNS = ("event_id", "transaction_id", "merchant_id", "merchant_name",
                    "event_type", "amount", "currency", "occurred_at", "batch_id", "pos")

# Columns of the deduplicated event log (one row per event_id).
LOG_COLUMNS = ("event_id", "transaction_id", "merchant_id", "event_type", "amount",
               "currency", "occurred_at", "batch_id", "pos")
