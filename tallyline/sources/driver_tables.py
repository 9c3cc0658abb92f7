"""Derive payment deliveries from the driver's generated tables.

``events`` rows become payment lifecycle deliveries; ``nation`` names the
merchants. Every 50th event is delivered a second time in batch 1 to model an
at-least-once feed: the replays are added rows, nothing is dropped.
The same mapping is written in SQL in ``tallyline.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.schema import MONEY

# Fixed values of the mapping.
EVENT_TYPE_MAP = {
    "view": "payment_initiated",
    "click": "payment_initiated",
    "purchase": "payment_processed",
    "error": "payment_failed",
    "signup": "settled",
}
TXN_PER_USER_DAY = 1000      # transaction_id = user_id * 1000 + day of year
MERCHANTS = 25               # merchant_id = user_id % 25 (nation keys 0..24)
REPLAY_EVERY = 50            # event_id % 50 = 0 is delivered twice
CURRENCY = "INR"


# Read DataFrames of the (read-only) driver tables, per application: reusing
# one keeps its file listing and footer schema.
_TABLES: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        key = (spark.sparkContext.applicationId, path)
    except Exception:  # no SparkContext handle: read afresh each time
        return spark.read.parquet(path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def mapped_event_type(source: Column) -> Column:
    out = None
    for k, v in EVENT_TYPE_MAP.items():
        out = F.when(source == k, F.lit(v)) if out is None else out.when(source == k, F.lit(v))
    return out.otherwise(source)


def transaction_key() -> Column:
    return F.col("user_id") * F.lit(TXN_PER_USER_DAY) + F.dayofyear("ts")


def merchant_key() -> Column:
    return F.col("user_id") % F.lit(MERCHANTS)


def merchant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("merchant_id"),
        F.col("n_name").alias("merchant_name"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed deliveries: one scan of ``events``; a replay is an exploded copy."""
    events = read_table(spark, sf_dir, "events")
    copies = F.when(F.col("event_id") % REPLAY_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = events.select(
        F.col("event_id"),
        transaction_key().alias("transaction_id"),
        merchant_key().alias("merchant_id"),
        mapped_event_type(F.col("event_type")).alias("event_type"),
        F.col("value").cast(MONEY).alias("amount"),
        F.lit(CURRENCY).alias("currency"),
        F.col("ts").alias("occurred_at"),
        F.explode(copies).alias("batch_id"),
        F.col("event_id").alias("pos"),
    )
    # Names come from a key-distinct view of ``nation`` through a left join:
    # plans that never read merchant_name (log, pivot, labels) drop the join
    # entirely, and those that do broadcast the 25-row side by its size.
    names = merchant_names(spark, sf_dir).groupBy("merchant_id").agg(F.max("merchant_name").alias("merchant_name"))
    return rows.join(names, "merchant_id", "left").select(
        "event_id", "transaction_id", "merchant_id", "merchant_name", "event_type",
        "amount", "currency", "occurred_at", "batch_id", "pos",
    )


# ---------------------------------------------------------------------------
# Wire-format deliveries (text fields) with deterministic corruptions, for the
# validation gate. Every event appears once; ``event_id % CORRUPT_CYCLE``
# decides which field (if any) is damaged, so DuckDB can rebuild the same rows.
# ---------------------------------------------------------------------------
CORRUPT_CYCLE = 20
# Fixed corruption kinds by residue (others are left valid).
CORRUPTIONS = {
    1: "event_type 'banana'",
    2: "event_id 'not-a-uuid'",
    3: "amount '-5.00'",
    4: "currency 'RUPEES'",
    5: "timestamp 'yesterday'",
    6: "merchant_id ''",
    7: "amount '1.239'",
    8: "currency 'IN1'",
    9: "unknown field 'note'",
    10: "currency 'inr' (valid once upper-cased)",
    11: "timestamp with +05:30 offset (valid, converted to UTC)",
    12: "upper-case event_id (valid, canonicalised)",
    13: "amount missing",
    14: "merchant_name of 256 characters",
    15: "amount '1234567890123.00' (13 whole digits)",
    16: "transaction_id missing",
    17: "amount with leading zeros '0012.50' (valid)",
}
_TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def uuid_text(key: Column, group: str) -> Column:
    """A valid UUID text built from a bigint key."""
    return F.concat(F.lit(f"00000000-0000-4000-{group}-"), F.lpad(F.lower(F.hex(key)), 12, "0"))


def wire_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").join(
        merchant_names(spark, sf_dir).withColumnRenamed("merchant_id", "_m"),
        merchant_key() == F.col("_m"))
    k = F.col("event_id") % CORRUPT_CYCLE
    event_uuid = uuid_text(F.col("event_id"), "8000")
    amount = F.col("value").cast(MONEY).cast("string")
    ts_text = F.date_format("ts", _TS_TEXT)
    shifted = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), _TS_TEXT), F.lit("+05:30"))
    return e.select(
        F.lit(0).alias("batch_id"),
        F.col("event_id").alias("pos"),
        F.when(k == 2, F.lit("not-a-uuid")).when(k == 12, F.upper(event_uuid)).otherwise(event_uuid).alias("event_id"),
        F.when(k == 1, F.lit("banana")).otherwise(mapped_event_type(F.col("event_type"))).alias("event_type"),
        F.when(k == 16, F.lit(None).cast("string")).otherwise(uuid_text(transaction_key(), "9000")).alias("transaction_id"),
        F.when(k == 6, F.lit("")).otherwise(merchant_key().cast("string")).alias("merchant_id"),
        F.when(k == 14, F.repeat(F.lit("x"), 256)).otherwise(F.col("merchant_name")).alias("merchant_name"),
        (F.when(k == 3, F.lit("-5.00")).when(k == 7, F.lit("1.239")).when(k == 13, F.lit(None).cast("string"))
          .when(k == 15, F.lit("1234567890123.00")).when(k == 17, F.concat(F.lit("00"), amount))
          .otherwise(amount)).alias("amount"),
        (F.when(k == 4, F.lit("RUPEES")).when(k == 8, F.lit("IN1")).when(k == 10, F.lit("inr"))
          .otherwise(F.lit(CURRENCY))).alias("currency"),
        F.when(k == 5, F.lit("yesterday")).when(k == 11, shifted).otherwise(ts_text).alias("timestamp"),
        F.when(k == 9, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("extra_keys"),
    )
