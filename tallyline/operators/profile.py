"""Profiling analyses over deliveries, log and projection (M1-M7)."""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.rules import RULES, age_hours, age_seconds, ts_literal
from tallyline.operators.ingest import label_deliveries
from tallyline.operators.projection import project_transactions
from tallyline.schema import PAYMENT_STATUSES

SHAPE_SEP = ">"


def shape_parts_fn(sep: str = SHAPE_SEP, keep: tuple[str, ...] = ()):
    """Build the per-partition function for ``mapInPandas``.

    Built inside a factory so it is shipped to Python workers by value: the
    workers need pandas, not this package on their path.
    """
    import pandas as pd

    def shape_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per sorted partition: one ``(txn, first event, joined types)`` per txn slice.

        Input rows arrive sorted by (transaction_id, occurred_at, event_id). A slice
        of the same transaction may continue into the next Arrow batch, so the last
        slice of each batch is carried forward; memory is bounded by one partition.
        """
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            parts = (pdf.groupby("transaction_id", sort=False)
                     .agg(first_at=("occurred_at", "first"), first_event_id=("event_id", "first"),
                          shape=("event_type", sep.join), **{k: (k, "first") for k in keep})
                     .reset_index())
            if carry is not None:
                if parts.at[0, "transaction_id"] == carry.at[0, "transaction_id"]:
                    parts.at[0, "first_at"] = carry.at[0, "first_at"]
                    parts.at[0, "first_event_id"] = carry.at[0, "first_event_id"]
                    parts.at[0, "shape"] = carry.at[0, "shape"] + sep + parts.at[0, "shape"]
                else:
                    parts = pd.concat([carry, parts], ignore_index=True)
            carry = parts.iloc[[-1]].reset_index(drop=True)
            done = parts.iloc[:-1]
            if not done.empty:
                yield done
        if carry is not None:
            yield carry

    return shape_parts


def transaction_shapes(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ordered event-type sequence per transaction (after dedup), as one text.

    A global sort on (transaction_id, occurred_at, event_id) range-partitions
    the log, so a transaction holding a third of all events still spans many
    tasks. Each task emits one partial sequence per transaction slice; the
    slices (at most one per partition) are then joined in event order. ``keep``
    names columns that are the same in all rows of a transaction.
    """
    fields = {f.name: f.dataType for f in log.schema}
    schema = T.StructType([
        T.StructField("transaction_id", fields["transaction_id"]), T.StructField("first_at", fields["occurred_at"]),
        T.StructField("first_event_id", fields["event_id"]), T.StructField("shape", T.StringType()),
        *[T.StructField(k, fields[k]) for k in keep],
    ])
    parts = (log.select("transaction_id", "occurred_at", "event_id", "event_type", *keep)
             .orderBy("transaction_id", "occurred_at", "event_id")
             .mapInPandas(shape_parts_fn(keep=keep), schema))
    ordered = F.array_sort(F.collect_list(F.struct("first_at", "first_event_id", "shape")))
    return (parts.groupBy("transaction_id", *keep).agg(ordered.alias("_parts"))
            .select("transaction_id", *keep,
                    F.array_join(F.transform("_parts", lambda p: p["shape"]), SHAPE_SEP).alias("shape")))


# The digest of a sequence is a polynomial in each of these bases, modulo a
# prime whose products fit 64 bits: about 124 bits in all.
DIGEST_PRIME = 2**31 - 1
DIGEST_BASES = (1_103_515_245, 1_566_083_941, 742_938_285, 1_226_874_159)


def digest_parts_fn(bases: tuple[int, ...] = DIGEST_BASES, prime: int = DIGEST_PRIME):
    """Per-partition function for ``mapInPandas``: one (transaction, first
    event, length, digest, weight) per transaction slice of sorted rows, where
    the weight is base ** length. What is carried from one Arrow batch to the
    next is of fixed size, however long the transaction."""
    import numpy as np
    import pandas as pd

    def powers(n: int) -> np.ndarray:
        out = np.ones((n + 1, len(bases)), np.uint64)
        for i in range(1, n + 1):
            out[i] = out[i - 1] * np.array(bases, np.uint64) % np.uint64(prime)
        return out

    def digest_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, carry = powers(1), None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            if len(table) <= n:
                table = powers(2 * n)
            ids = pdf["transaction_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            sizes = np.diff(np.append(starts, n))
            left = np.repeat(starts + sizes, sizes) - 1 - np.arange(n)      # events after this one in its slice
            codes = np.stack(pdf["codes"].to_numpy()).astype(np.uint64)
            sums = np.add.reduceat(codes * table[left] % np.uint64(prime), starts, axis=0) % np.uint64(prime)
            parts = pdf.iloc[starts][["transaction_id", "occurred_at", "event_id"]].copy()
            parts.columns = ["transaction_id", "first_at", "first_event_id"]
            parts["events"] = sizes
            parts["digest"], parts["weight"] = list(sums.astype(np.int64)), list(table[sizes].astype(np.int64))
            parts = parts.reset_index(drop=True)
            if carry is not None and carry.at[0, "transaction_id"] == parts.at[0, "transaction_id"]:
                head, tail = carry.loc[0], parts.loc[0]
                merged = carry.copy()
                merged.at[0, "events"] = head["events"] + tail["events"]
                merged.at[0, "digest"] = (head["digest"] * tail["weight"] + tail["digest"]) % prime
                merged.at[0, "weight"] = head["weight"] * tail["weight"] % prime
                parts = pd.concat([merged, parts.iloc[1:]], ignore_index=True)
            elif carry is not None:
                parts = pd.concat([carry, parts], ignore_index=True)
            carry = parts.iloc[[-1]].reset_index(drop=True)
            if len(parts) > 1:
                yield parts.iloc[:-1]
        if carry is not None:
            yield carry

    return digest_parts


def shape_digests(log: DataFrame) -> DataFrame:
    """(transaction_id, events, digest) of every transaction's ordered event
    types; no text of a transaction is built anywhere. Digests of slices are
    combined in event order: d(xy) = d(x) * base ** length(y) + d(y)."""
    fields = {f.name: f.dataType for f in log.schema}
    schema = T.StructType([
        T.StructField("transaction_id", fields["transaction_id"]), T.StructField("first_at", fields["occurred_at"]),
        T.StructField("first_event_id", fields["event_id"]), T.StructField("events", T.LongType()),
        T.StructField("digest", T.ArrayType(T.LongType())), T.StructField("weight", T.ArrayType(T.LongType())),
    ])
    codes = F.array(*[F.pmod(F.xxhash64("event_type", F.lit(lane)), F.lit(DIGEST_PRIME)) for lane in range(len(DIGEST_BASES))])
    parts = (log.select("transaction_id", "occurred_at", "event_id", codes.alias("codes"))
             .orderBy("transaction_id", "occurred_at", "event_id")
             .mapInPandas(digest_parts_fn(), schema))
    slices = F.array_sort(F.collect_list(F.struct("first_at", "first_event_id", "digest", "weight")))
    zero = F.array(*[F.lit(0).cast("long")] * len(DIGEST_BASES))
    whole = F.aggregate(F.col("_slices"), zero, lambda done, part: F.transform(
        done, lambda d, i: F.pmod(d * F.get(part["weight"], i) + F.get(part["digest"], i), F.lit(DIGEST_PRIME))))
    return (parts.groupBy("transaction_id").agg(F.sum("events").alias("events"), slices.alias("_slices"))
            .select("transaction_id", "events", whole.alias("digest")))


def profile_shapes(log: DataFrame) -> DataFrame:
    """M1: how many transactions follow each event sequence. Transactions are
    counted by digest; a text is built for one transaction of each sequence."""
    counted = shape_digests(log).groupBy("events", "digest").agg(
        F.count(F.lit(1)).alias("transactions"), F.min("transaction_id").alias("transaction_id"))
    shown = log.select("transaction_id", "occurred_at", "event_id", "event_type").join(
        counted.select("transaction_id", "transactions"), "transaction_id")
    return (transaction_shapes(shown, keep=("transactions",)).select("shape", "transactions")
            .orderBy(F.col("transactions").desc(), F.col("shape")))


def settlement_bucket() -> F.Column:
    return (F.when(F.col("first_settled_at").isNull(), F.lit("unsettled"))
             .when(F.col("settled_event_count") > 1, F.lit("settled_multi"))
             .otherwise(F.lit("settled_once")))


def profile_matrix(txn: DataFrame) -> DataFrame:
    """M2: payment status x (unsettled / settled once / settled more than once)."""
    buckets = ["unsettled", "settled_once", "settled_multi"]
    # Explicit pivot values: one aggregation pass, no job to discover them.
    counts = (txn.withColumn("_bucket", settlement_bucket())
              .groupBy("payment_status").pivot("_bucket", buckets).count())
    return (counts.select("payment_status", *[F.coalesce(F.col(b), F.lit(0)).cast("long").alias(b) for b in buckets])
            .orderBy(F.array_position(F.array(*[F.lit(s) for s in PAYMENT_STATUSES]), F.col("payment_status"))))


LAG_STEP_US = 60_000_000   # lags are first counted by the minute


def exact_percentiles(values: DataFrame, value: str, shares: dict[str, float], step: int) -> DataFrame:
    """One row: the value of rank ceil(share x n) for each share, exact at any size.

    Values are counted in ranges of ``step``; the ranges' running counts (one
    row per occupied range) show which range holds each rank, and only that
    range is ranked value by value. Both windows run over counts, never rows.
    """
    ranged = values.select(F.col(value).alias("v"), F.floor(F.col(value) / F.lit(step)).alias("r"))
    counts = ranged.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.select("r", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(x).alias("share")) for k, x in shares.items()]))
    ranks = running.select("r", "n", "upto", "total", wanted.alias("w")).select(
        "r", F.col("w.name").alias("name"), (F.col("upto") - F.col("n")).alias("before"), "upto",
        F.greatest(F.ceil(F.col("w.share") * F.col("total")), F.lit(1)).alias("rank"))
    ranks = ranks.filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    inside = ranged.join(ranks, "r").groupBy("name", "before", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (inside.withColumn("at", F.sum("n").over(at) + F.col("before")).filter(F.col("at") >= F.col("rank"))
             .groupBy("name").agg(F.min("v").alias("v")))
    return found.agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares])


def profile_lag(txn: DataFrame) -> DataFrame:
    """M3: settlement lag (first settlement - processing), exact p50 / p99 / max in hours."""
    lag_us = F.unix_micros(F.col("first_settled_at").cast("timestamp")) - F.unix_micros(
        F.col("processed_at").cast("timestamp"))
    lags = txn.filter(F.col("processed_at").isNotNull() & F.col("first_settled_at").isNotNull()).select(lag_us.alias("lag"))
    ends = lags.agg(F.count(F.lit(1)).alias("settled_after_processing"), F.max("lag").alias("_max"))
    hours = lambda c: F.round(F.col(c) / F.lit(3_600_000_000.0), 6)
    return ends.crossJoin(exact_percentiles(lags, "lag", {"_p50": 0.5, "_p99": 0.99}, LAG_STEP_US)).select(
        "settled_after_processing", hours("_p50").alias("p50_hours"), hours("_p99").alias("p99_hours"),
        hours("_max").alias("max_hours"))


def profile_unsettled_age(txn: DataFrame, as_of) -> DataFrame:
    """M4: youngest processed-but-never-settled transaction, ignoring the SLA."""
    never = RULES["processed_never_settled"](ts_literal("9999-12-31 00:00:00"))
    secs = age_seconds(as_of)
    out = txn.filter(never).agg(F.count(F.lit(1)).alias("never_settled"), F.min(secs).alias("min_age_seconds"))
    return out.withColumn("min_age_hours", age_hours(F.col("min_age_seconds")))


def profile_duplicates(deliveries: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """M5: duplicate deliveries by event type."""
    return (label_deliveries(deliveries, log).filter(F.col("status") == "duplicate")
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("duplicates")))


def profile_naive_vs_dedup(deliveries: DataFrame, txn: DataFrame) -> DataFrame:
    """M6: duplicate settlements counted on raw deliveries vs on the deduplicated log."""
    naive = project_transactions(deliveries).agg(
        F.count_if(F.col("settled_event_count") > 1).alias("naive_duplicate_settlements"))
    dedup = txn.agg(F.count_if(F.col("settled_event_count") > 1).alias("dedup_duplicate_settlements"))
    return (naive.crossJoin(dedup)
            .withColumn("false_positives", F.col("naive_duplicate_settlements") - F.col("dedup_duplicate_settlements")))


def profile_ratio(txn: DataFrame) -> DataFrame:
    """M7: log rows per transaction (the recompute's read amplification)."""
    return txn.agg(F.sum("event_count").alias("events"), F.count(F.lit(1)).alias("transactions"),
                   F.round(F.avg("event_count"), 6).alias("events_per_transaction"),
                   F.max("event_count").alias("max_events_per_transaction"))
