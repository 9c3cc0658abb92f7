"""The three derived status axes (payment, settlement, flattened).

``with_status`` is the only producer of these columns. Any stored copy is
dropped and re-derived from the milestone timestamps, so a stale value can
never be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_COLUMNS = ("payment_status", "settlement_status", "status")


def payment_status() -> Column:
    """failed beats processed beats pending."""
    return (F.when(F.col("failed_at").isNotNull(), F.lit("failed"))
             .when(F.col("processed_at").isNotNull(), F.lit("processed"))
             .otherwise(F.lit("pending")))


def settlement_status() -> Column:
    return F.when(F.col("first_settled_at").isNotNull(), F.lit("settled")).otherwise(F.lit("unsettled"))


def flat_status() -> Column:
    """Convenience axis: settled > failed > processed > pending."""
    return (F.when(F.col("first_settled_at").isNotNull(), F.lit("settled"))
             .when(F.col("failed_at").isNotNull(), F.lit("failed"))
             .when(F.col("processed_at").isNotNull(), F.lit("processed"))
             .otherwise(F.lit("pending")))


def status_condition(axis: str, value: str) -> Column:
    """``axis = value`` written as tests on the stored milestones, which reach
    the Parquet scan; a test on the derived status would not."""
    seen = {name: F.col(c).isNotNull() for name, c in (
        ("settled", "first_settled_at"), ("failed", "failed_at"), ("processed", "processed_at"))}
    if axis == "settlement_status":
        return seen["settled"] if value == "settled" else ~seen["settled"]
    order = ["settled", "failed", "processed"] if axis == "status" else ["failed", "processed"]
    out = None
    for name in order[:order.index(value)] if value in order else order:
        out = ~seen[name] if out is None else out & ~seen[name]
    if value not in order:
        return out
    return seen[value] if out is None else out & seen[value]


def with_status(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in STATUS_COLUMNS]
    return df.select(*keep, payment_status().alias("payment_status"),
                     settlement_status().alias("settlement_status"), flat_status().alias("status"))
