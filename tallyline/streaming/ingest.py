"""Structured Streaming ingest.

The live feed is unordered and at-least-once, with an unlimited dedup horizon
(a partner may replay months later). So the streaming job keeps no dedup state
of its own: each micro-batch goes through the same batch ingest as a backfill
(``EventStore.ingest`` inside ``foreachBatch``), which anti-joins against the
stored log and appends what is new. No watermark: late data is never dropped,
and any arrival order converges to the rebuild.

``running_state_stream`` is the pure streaming alternative (P4): Spark keeps
dedup and aggregation state in its state store. It is exact, but that state
grows without bound, which is why the log-backed path is the default.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.status import with_status
from tallyline.operators import validate as V
from tallyline.operators.projection import PROJECTION_COLUMNS
from tallyline.schema import DELIVERY_COLUMNS
from tallyline.session import settings
from tallyline.sources.store import EventStore


def query_feed(spark: SparkSession, checkpoint: str) -> str:
    """The feed name of a stream: its query id, which its checkpoint keeps
    across restarts and which a new checkpoint does not share."""
    kept = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
    return f"stream:{json.loads(kept)['id']}"


def ingest_batch_fn(store: EventStore, wire: bool = False, on_error: str = "quarantine", checkpoint: str | None = None,
                    feed: str | None = None, report: bool = False):
    """The ``foreachBatch`` body: validate (for wire input), then ingest.

    Spark replays a failed micro-batch with the same number, and the store
    overwrites that batch of the feed.
    With ``report`` the store keeps what each micro-batch came to.
    """
    def run(batch: DataFrame, number: int) -> None:
        source = feed or (query_feed(store.spark, checkpoint) if checkpoint else "stream")
        if wire:
            if "raw_json" not in batch.columns and "value" in batch.columns:
                batch = wire_frame(batch, number)
            checked = V.validate(batch).persist()
            try:
                deliveries = V.gate(checked, on_error)
                rejected = store.quarantine(V.quarantine(checked), source, number) if on_error == "quarantine" else 0
                totals = {**store.ingest(deliveries, number, source), "rejected": rejected}
            finally:
                checked.unpersist()
        else:
            totals = store.ingest(batch.select(*DELIVERY_COLUMNS), number, source)
        if report:
            store.record_chunk(source, number, totals)
    return run


def run_ingest_stream(spark: SparkSession, source: DataFrame, store: EventStore, checkpoint: str,
                      wire: bool = False, on_error: str = "quarantine") -> StreamingQuery:
    """Drain ``source`` (a streaming DataFrame) into the store.

    Uses ``Trigger.AvailableNow``: it processes everything present (respecting
    the source's ``maxFilesPerTrigger``) and stops, the same code path as a
    continuously running feed. Returns the finished query.
    """
    query = (source.writeStream.foreachBatch(ingest_batch_fn(store, wire, on_error, checkpoint))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    return query


def json_lines_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A2: a live feed of JSON Lines files (one event per line), as raw text."""
    from tallyline.sources.json_events import text_lines

    return text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def wire_frame(lines: DataFrame, batch_id: int) -> DataFrame:
    """Parse one micro-batch of JSON lines into the text-typed wire frame.

    ``pos`` numbers the lines of the micro-batch's files in file order, which
    Spark replays from the same files after a failure.
    """
    from tallyline.sources.json_events import numbered_events, numbered_lines, wire_from_json

    return wire_from_json(numbered_lines(lines) if "block" in lines.columns else numbered_events(lines), batch_id)


def json_documents_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A1/A5: files that hold one event or an array of them, as text."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(path)
            .select("value", F.col("_metadata.file_path").alias("file")))


def delivery_file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A5: a chunked, resumable source: one micro-batch per ``files_per_trigger`` files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def running_state_stream(source: DataFrame) -> DataFrame:
    """Per-transaction running state maintained by Spark's state store.

    ``dropDuplicates`` keeps every event_id seen (no watermark, exact), then the
    milestone aggregates update per micro-batch; run in ``update`` mode.
    """
    events = source.dropDuplicates(["event_id"])
    when_type = lambda t: F.when(F.col("event_type") == t, F.col("occurred_at"))
    return events.groupBy("transaction_id").agg(
        F.min("merchant_id").alias("merchant_id"),
        F.min("amount").alias("amount"),
        F.min("currency").alias("currency"),
        F.min(when_type("payment_initiated")).alias("initiated_at"),
        F.min(when_type("payment_processed")).alias("processed_at"),
        F.min(when_type("payment_failed")).alias("failed_at"),
        F.min(when_type("settled")).alias("first_settled_at"),
        F.max(when_type("settled")).alias("last_settled_at"),
        F.count_if(F.col("event_type") == "settled").alias("settled_event_count"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("occurred_at").alias("first_event_at"),
        F.max("occurred_at").alias("last_event_at"),
    )


# The state grows with the feed: it is kept on the executors' disks, outside the
# heap, and each micro-batch checkpoints its changes instead of the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_running_state(source: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Drain ``running_state_stream`` in update mode; return the latest state.

    Each micro-batch's updated rows are written under ``version=<batch_id>``;
    the current state is the newest version of each transaction.
    """
    with settings(source.sparkSession, STATE_STORE):
        _drain_running_state(source, out_path, checkpoint)
    versions = source.sparkSession.read.parquet(out_path)
    latest = versions.groupBy("transaction_id").agg(
        F.max_by(F.struct(*[c for c in PROJECTION_COLUMNS if c != "transaction_id"]), F.col("version")).alias("s"))
    return with_status(latest.select("transaction_id", "s.*"))


def _drain_running_state(source: DataFrame, out_path: str, checkpoint: str) -> None:
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("version", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").partitionBy("version").parquet(out_path))

    query = (running_state_stream(source).writeStream.outputMode("update")
             .foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
