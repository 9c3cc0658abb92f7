"""Catalog tables over stored folders: optimiser statistics and bucketed joins.

A8: a stored folder gets a table in the session's catalog; ``analyze`` has Spark
compute row counts and column statistics, which the cost-based planner uses
once ``spark.sql.cbo.enabled`` is set, and ``statistics`` reads them back.

F4: ``history_tables`` writes transactions and their events bucketed by
(transaction, slice) and sorted, so that joining them needs no exchange. A
transaction with many events has several slices, dealt by a hash of the event
id: no row holds more than a slice of it. A bucket is sorted in one task when it is
written and again when it is read, so the tables have buckets of their own, as many
as bound that sort, and not those of the store.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_EVENTS = 10_000    # events of a transaction in one slice (expected)
BUCKET_EVENTS = 500_000  # events in one bucket (expected); Spark sorts them in about 180 bytes each
MAX_BUCKETS_CONF = "spark.sql.sources.bucketing.maxBuckets"
STATISTICS = "table string, column string, type string, rows long, nulls long, min_value string, max_value string"
EVENT_FIELDS = ("occurred_at", "event_id", "event_type", "amount", "currency")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An external table over the Parquet folder ``path``. Dropping it, as this
    does with an earlier one of the name, leaves the files alone."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {_quoted(name)} USING parquet LOCATION '{location}'")
    if any(f.isPartition for f in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def analyze(spark: SparkSession, name: str) -> None:
    """Recompute a table's statistics, in two distributed passes."""
    spark.sql(f"ANALYZE TABLE {_quoted(name)} COMPUTE STATISTICS FOR ALL COLUMNS")


def statistics(spark: SparkSession, names: list[str]) -> DataFrame:
    """What the optimiser knows of analysed tables: one row per table and column.

    Least and greatest values are kept for numbers and times only. The rows come
    from the catalog, at most one per column of a table.
    """
    out = []
    for name in names:
        about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").collect()}
        known = re.search(r"(\d+) rows", about.get("Statistics") or "")
        for field in spark.table(name).schema:
            said = {r["info_name"]: r["info_value"]
                    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)} {_quoted(field.name)}").collect()}
            get = lambda k: None if said.get(k) in (None, "NULL") else said[k]
            nulls = get("num_nulls")
            out.append((name, field.name, field.dataType.simpleString(), int(known.group(1)) if known else None,
                        None if nulls is None else int(nulls), get("min"), get("max")))
    return spark.createDataFrame(out, STATISTICS)


def _slices(event_count: Column, most: int) -> Column:
    return F.greatest(F.ceil(event_count / most), F.lit(1)).cast("int")


def history_buckets(spark: SparkSession, events: int) -> int:
    """Buckets for a log of so many events. Beyond the most that the session allows
    (100,000 by default) they grow, and their sorts spill."""
    return min(max(-(-events // BUCKET_EVENTS), 1), int(spark.conf.get(MAX_BUCKETS_CONF)))


def history_tables(log: DataFrame, txn: DataFrame, path: str, name: str, buckets: int, slice_events: int = SLICE_EVENTS) -> tuple[DataFrame, DataFrame]:
    """``txn`` and ``log`` written as tables ``name``_txn and ``name``_events
    under ``path``, bucketed by (transaction_id, slice). Only transactions of
    several slices are looked up while the events are written; events without a
    transaction are dealt into slices like one."""
    spark = log.sparkSession
    n = _slices(F.col("event_count"), slice_events)
    sliced = txn.withColumn("slices", n).withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    hot = txn.filter(F.col("event_count") > slice_events).select(F.col("transaction_id").alias("_hot"), n.alias("slices"))
    events = log.join(hot, F.col("transaction_id").eqNullSafe(F.col("_hot")), "left").withColumn(
        "slice", F.pmod(F.xxhash64("event_id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("_hot", "slices")
    for side, rows, order in (("txn", sliced, ()), ("events", events, ("occurred_at", "event_id"))):
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{name}_{side}')}")
        (rows.repartition(buckets, "transaction_id", "slice").write.mode("overwrite").format("parquet")
         .bucketBy(buckets, "transaction_id", "slice").sortBy("transaction_id", "slice", *order)
         .option("path", f"{path.rstrip('/')}/{side}").option("partitionOverwriteMode", "static").saveAsTable(f"{name}_{side}"))
    return spark.table(f"{name}_txn"), spark.table(f"{name}_events")


def with_history(txn: DataFrame, events: DataFrame) -> DataFrame:
    """Each slice of a transaction with its events, oldest first, as an
    array of structs of bounded length. Neither side is shuffled: the events of
    a slice are merged inside their bucket."""
    struct = F.struct(*EVENT_FIELDS)
    merged = events.groupBy("transaction_id", "slice").agg(F.array_sort(F.collect_list(struct)).alias("events"))
    return txn.join(merged, ["transaction_id", "slice"], "left").withColumn(
        "events", F.coalesce("events", F.array().cast(merged.schema["events"].dataType)))
