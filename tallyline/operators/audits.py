"""Data-quality audits over the log and the projection (expect zero rows).

Parquet enforces no keys or constraints, so the guarantees a relational store
gives by DDL are checked here as queries: CHECK constraints (B10), foreign
keys (B11), per-transaction invariants (B12) and key uniqueness (B13). All of
them are aggregations with map-side combine or anti joins; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_constraints(txn: DataFrame) -> DataFrame:
    """Rows violating amount >= 0, counts >= 0, or having no milestone."""
    checks = {
        "negative_amount": F.col("amount") < 0,
        "negative_count": (F.col("settled_event_count") < 0) | (F.col("event_count") < 0),
        "no_evidence": (F.col("initiated_at").isNull() & F.col("processed_at").isNull()
                        & F.col("failed_at").isNull() & F.col("first_settled_at").isNull()),
    }
    violations = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return (txn.select("transaction_id", violations.alias("_v"))
            .select("transaction_id", F.explode("_v").alias("violation")))


def audit_orphans(txn: DataFrame, log: DataFrame, merchants: DataFrame) -> DataFrame:
    """Transactions and events whose merchant is missing from the dimension."""
    keys = merchants.select("merchant_id")
    t = (txn.join(keys, "merchant_id", "left_anti")
         .select(F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id"), "merchant_id"))
    e = (log.join(keys, "merchant_id", "left_anti")
         .select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "merchant_id"))
    return t.unionByName(e)


def audit_invariants(log: DataFrame) -> DataFrame:
    """Transactions whose events disagree on merchant, amount or currency.

    ``min != max`` is the algebraic form of ``count(DISTINCT) > 1`` for non-null
    values, so it combines map-side instead of expanding distinct pairs.
    """
    agg = log.groupBy("transaction_id").agg(
        F.min("merchant_id").alias("min_merchant_id"), F.max("merchant_id").alias("max_merchant_id"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.min("currency").alias("min_currency"), F.max("currency").alias("max_currency"),
    )
    merchant = F.col("min_merchant_id") != F.col("max_merchant_id")
    amount = F.col("min_amount") != F.col("max_amount")
    currency = F.col("min_currency") != F.col("max_currency")
    return (agg.filter(merchant | amount | currency)
            .select("transaction_id", merchant.alias("merchant_conflict"), amount.alias("amount_conflict"),
                    currency.alias("currency_conflict"), "min_amount", "max_amount"))


def audit_keys(deliveries: DataFrame, log: DataFrame, txn: DataFrame) -> DataFrame:
    """Duplicate keys in log/projection, and event_ids seen under two transactions.

    The last check guards the single-shuffle fast path (dedup inside a
    transaction partition), which is only exact if it returns nothing.
    """
    dup_event = (log.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .select(F.lit("log_event_id").alias("check"), F.col("event_id").alias("key"), "n"))
    dup_txn = (txn.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
               .select(F.lit("projection_transaction_id").alias("check"), F.col("transaction_id").alias("key"), "n"))
    split_event = (deliveries.groupBy("event_id")
                   .agg(F.min("transaction_id").alias("lo"), F.max("transaction_id").alias("hi"))
                   .filter(F.col("lo") != F.col("hi"))
                   .select(F.lit("event_in_two_transactions").alias("check"), F.col("event_id").alias("key"),
                           F.lit(2).cast("long").alias("n")))
    return dup_event.unionByName(dup_txn).unionByName(split_event)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C11: order-independent state fingerprint: row count + XOR of row hashes.

    Equal state gives an equal fingerprint regardless of partitioning or row
    order, and the aggregate combines map-side (no sort, no collect).
    """
    cols = columns or sorted(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.bit_xor(F.xxhash64(*[F.col(c) for c in cols])).alias("xor_hash"))


def multiset_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C11: row count and the sums of both halves of every row's MD5. Unlike an
    XOR, equal rows do not cancel; any order and partitioning give the same
    sums, partial sums combine map-side, and any SQL engine can compute them.

    A row's text is its columns' texts, each led by its length in code points (a null is
    "-"), so that no two rows read alike.
    """
    texts = [F.col(c).cast("string") for c in (columns or df.columns)]
    row = F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts])
    md5 = F.md5(row.cast("binary"))
    half = lambda at: F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(20,0)")
    none = F.lit(0).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.coalesce(F.sum(half(at)).cast("decimal(38,0)"), none).alias(name) for at, name in ((1, "high_sum"), (17, "low_sum"))])
