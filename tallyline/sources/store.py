"""The stored state: an append-only event log, and what is derived from it.

Layout under ``root`` (any Hadoop-compatible shared path)::

    log/feed=F/batch_id=N/        first deliveries of batch N of feed F (the truth)
    names/feed=F/batch_id=N/      one row per merchant the batch delivered: its last name
                                  there and the number of deliveries
    projection/bucket=B/          one row per transaction, as of the last ``rebuild``
    dimension/                    merchant names, as of the last ``rebuild``
    quarantine/feed=F/batch_id=N/ rejected wire rows with their errors
    chunks/feed=F/batch_id=N/     what a chunk of a resumable load came to
    loads/NAME/                   the file source's checkpoint of the load NAME
    _layout, _derived, _complete  one-row markers: bucket count, the batches that the
                                  derived tables are of, the source of a full load

A batch is named by its feed and its number there, so two feeds may both start at 0.
Ingesting it writes the partitions of that batch and nothing else: a retry replaces
itself (dynamic partition overwrite), and no other file is read again but for the
duplicate probe. Transactions and merchant names are groupings of the log and of
``names``. ``rebuild`` writes them down; readers scan the written tables while these
cover every batch, and group otherwise, so no reader sees a log and a projection that
disagree. How often to rebuild is the operator's choice.

Single-writer assumption: like any plain Parquet layout there is no
cross-writer isolation; run one ingest at a time per store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyline.functions.status import with_status
from tallyline.operators.ingest import PROBE_SETTINGS, dedupe_events, probe_keys
from tallyline.operators.projection import PROJECTION_COLUMNS, project_transactions
from tallyline.schema import DELIVERY_COLUMNS, LOG_COLUMNS
from tallyline.session import settings

DEFAULT_BUCKETS = 64
# Target log rows per projection bucket when sizing a store from its input.
ROWS_PER_BUCKET = 16_000_000
# What reading a folder without data files reports; other errors are errors.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
CHUNK_TOTALS = ("received", "ingested", "duplicates", "rejected")

# Parquet bloom filters: row groups without the key are skipped by point lookups,
# and by the duplicate probe of a few events.
LOG_WRITE_OPTIONS = {"parquet.bloom.filter.enabled#transaction_id": "true", "parquet.bloom.filter.enabled#event_id": "true"}
PROJECTION_WRITE_OPTIONS = {"parquet.bloom.filter.enabled#transaction_id": "true"}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def log_rows(deliveries: DataFrame, prior: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """New log rows with their arrival time (C5) and the whole normalised event
    as JSON, named as on the wire (C6)."""
    fields = [c for c in DELIVERY_COLUMNS if c not in ("batch_id", "pos")]
    payload = F.to_json(F.struct(*[F.col(c).alias("timestamp" if c == "occurred_at" else c) for c in fields]))
    return (dedupe_events(deliveries, prior, ("merchant_name",), keys).withColumn("payload", payload).drop("merchant_name")
            .withColumn("received_at", _now()))


def name_rows(deliveries: DataFrame) -> DataFrame:
    """The last name of every merchant in every batch, and its deliveries there."""
    return (deliveries.groupBy("merchant_id", "batch_id")
            .agg(F.max_by("merchant_name", "pos").alias("merchant_name"), F.max("pos").alias("pos"),
                 F.count(F.lit(1)).alias("deliveries"))
            .withColumn("received_at", _now()))


def buckets_for(rows: int) -> int:
    """Power-of-two bucket count for ``rows`` log rows."""
    n = 1
    while n * ROWS_PER_BUCKET < rows:
        n *= 2
    return n


class EventStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        if buckets is None:
            layout = self._read(self.layout_path)
            buckets = layout.first()["buckets"] if layout is not None else DEFAULT_BUCKETS
        self.buckets = int(buckets)
        self.log_path, self.names_path = f"{self.root}/log", f"{self.root}/names"
        self.projection_path, self.dimension_path = f"{self.root}/projection", f"{self.root}/dimension"
        self.quarantine_path, self.chunks_path = f"{self.root}/quarantine", f"{self.root}/chunks"
        self.derived_path, self.complete_path = f"{self.root}/_derived", f"{self.root}/_complete"

    @property
    def layout_path(self) -> str:
        return f"{self.root}/_layout"

    # -- readers -----------------------------------------------------------------
    def _read(self, path: str) -> DataFrame | None:
        """The table at ``path`` as it is now, or None where there is none yet."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as err:
            if err.getCondition() not in ABSENT:
                raise
            return None

    def log(self) -> DataFrame | None:
        return self._read(self.log_path)

    def names(self) -> DataFrame | None:
        """Names as delivered: one row per merchant and batch."""
        return self._read(self.names_path)

    def _batches(self) -> int | None:
        """A digest of all batches and when each was written; None without any.
        ``names`` has few rows: one per merchant and batch."""
        names = self.names()
        stamp = F.xxhash64("feed", "batch_id", "merchant_id", "received_at")
        return None if names is None else names.agg(F.bit_xor(stamp)).first()[0]

    def derived_is_current(self) -> bool:
        """Whether the written projection and names cover every batch."""
        mark = self._read(self.derived_path)
        return mark is not None and mark.first()["batches"] == self._batches()

    def _transactions(self, key: Column | None = None) -> DataFrame:
        """The transactions (one of them, with a key): the written ones if they
        cover every batch, else grouped from the log."""
        here = F.lit(True) if key is None else F.col("transaction_id") == key
        if self.derived_is_current():
            bucket = F.lit(True) if key is None else F.col("bucket") == bucket_of(key, self.buckets)
            return with_status(self._read(self.projection_path).filter(bucket & here).select(*PROJECTION_COLUMNS))
        log = self.log()
        if log is None:
            raise FileNotFoundError(f"no transactions under {self.root}")
        return with_status(project_transactions(log.filter(here)).select(*PROJECTION_COLUMNS))

    def transactions(self) -> DataFrame:
        """All transactions; status axes are always re-derived on read."""
        return self._transactions()

    def lookup(self, transaction_id) -> DataFrame:
        """One transaction; from one bucket of the written projection where it
        is current, else from the row groups of the log that may hold the key."""
        return self._transactions(self._key(transaction_id))

    def _key(self, transaction_id) -> Column:
        # With the column's own type: an int literal and a bigint column hash differently.
        log = self.log()
        return F.lit(transaction_id).cast(log.schema["transaction_id"].dataType) if log is not None else F.lit(transaction_id)

    def history(self, transaction_id) -> DataFrame:
        """one transaction's events, oldest first. Bloom filters spare the row
        groups without it; ``sources.tables`` has bucketed tables for many of them."""
        return (self.log().filter(F.col("transaction_id") == self._key(transaction_id))
                .select(*LOG_COLUMNS, "received_at", "payload").orderBy("occurred_at", "event_id"))

    def touched(self, feed: str, batch: int) -> DataFrame:
        """The transactions that a batch added events to, as they now are."""
        log = self.log()
        ids = log.filter((F.col("feed") == feed) & (F.col("batch_id") == batch)).select("transaction_id").distinct()
        return with_status(project_transactions(log.join(ids, "transaction_id", "left_semi")).select(*PROJECTION_COLUMNS))

    def merchants(self) -> DataFrame | None:
        """Current merchant names: of the last arrival, then batch, then position."""
        if self.derived_is_current():
            return self._read(self.dimension_path)
        names = self.names()
        return None if names is None else self._latest(names)

    @staticmethod
    def _latest(names: DataFrame) -> DataFrame:
        return names.groupBy("merchant_id").agg(
            F.max_by("merchant_name", F.struct("received_at", "batch_id", "pos")).alias("merchant_name"))

    def is_complete(self, source: str | None = None) -> bool:
        """Whether a full load has finished (of this source, if one is named)."""
        mark = self._read(self.complete_path)
        return mark is not None and (source is None or mark.filter(F.col("source") == source).count() > 0)

    # -- writes ----------------------------------------------------------------
    def _mark(self, path: str, **values) -> None:
        (self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
         .write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path))

    def _ensure_layout(self) -> None:
        """Record the bucket count on first write; refuse a mismatched one."""
        layout = self._read(self.layout_path)
        if layout is None:
            self._mark(self.layout_path, buckets=self.buckets)
        elif int(layout.first()["buckets"]) != self.buckets:
            raise ValueError(f"store {self.root} is bucketed by {layout.first()['buckets']}, not {self.buckets}")

    def _append(self, rows: DataFrame, path: str, feed: str, static: bool = False, **options) -> None:
        """Write the partitions of the batches in ``rows`` (all of them: ``static``)."""
        if not feed[:1].isalpha():
            raise ValueError(f"the name of a feed starts with a letter: {feed!r}")
        (rows.withColumn("feed", F.lit(feed)).write.mode("overwrite")
         .option("partitionOverwriteMode", "static" if static else "dynamic").options(**options)
         .partitionBy("feed", "batch_id").parquet(path))

    def _append_log(self, events: DataFrame, feed: str, static: bool = False) -> int:
        """Write log rows; their number, counted by the tasks that write them."""
        # REBALANCE lets AQE size the files, whatever the batch.
        seen = Observation()
        rows = events.hint("rebalance").sortWithinPartitions("batch_id", "event_id")
        self._append(rows.observe(seen, F.count(F.lit(1)).alias("n")), self.log_path, feed, static, **LOG_WRITE_OPTIONS)
        return int(seen.get.get("n") or 0)

    def _append_names(self, deliveries: DataFrame, feed: str, static: bool = False) -> int:
        """Write the names; the number of deliveries, summed by the writing tasks."""
        seen = Observation()
        rows = name_rows(deliveries).observe(seen, F.sum("deliveries").alias("n"))
        self._append(rows, self.names_path, feed, static)
        return int(seen.get.get("n") or 0)

    def ingest(self, deliveries: DataFrame, batch: int | None = None, feed: str = "direct") -> dict:
        """Append a feed's batch.

        ``batch`` numbers the batches of ``feed``; the same number of the same
        feed is a retry. Without a number the batch is a feed of its own.

        Returns ``{received, ingested, duplicates}`` (C4), counted in the two
        writing jobs. Safe to retry: the duplicate probe leaves out the batch's own
        partition, which is then overwritten.
        """
        self._ensure_layout()
        if batch is None:
            feed, batch = f"{feed}:{uuid.uuid4().hex}", 0
        rows = deliveries.withColumn("batch_id", F.lit(batch).cast("int")).persist()
        keys = None
        try:
            prior = self.log()
            if prior is not None:
                prior = prior.filter(~((F.col("feed") == feed) & (F.col("batch_id") == batch)))
                keys = probe_keys(rows).persist()
            with settings(rows.sparkSession, PROBE_SETTINGS):
                ingested = self._append_log(log_rows(rows, prior, keys), feed)
            received = self._append_names(rows, feed)
            return {"received": received, "ingested": ingested, "duplicates": received - ingested}
        finally:
            rows.unpersist()
            if keys is not None:
                keys.unpersist()

    def load(self, deliveries: DataFrame, source: str = "") -> None:
        """Replace the whole store with ``deliveries`` (keeping their
        own batch ids), then derive projection and names. The mark of an earlier
        load goes first: a broken load is never taken for whole."""
        self._wipe(self.complete_path)
        self._ensure_layout()
        self._append_log(log_rows(deliveries), "load", static=True)
        self._append_names(deliveries, "load", static=True)
        self.rebuild()
        self._mark(self.complete_path, source=source)

    def rebuild(self) -> int:
        """Write projection and names anew from all batches. Files are
        sorted by ``initiated_at`` inside each bucket (the sort leads with the
        partition column, so the writer keeps it): row-group statistics prune date
        ranges and recency pages. The mark goes first and comes back last."""
        log, names = self.log(), self.names()
        if log is None or names is None:
            return 0
        self._wipe(self.derived_path)
        covered, seen = self._batches(), Observation()
        bucket = bucket_of(F.col("transaction_id"), self.buckets)
        (project_transactions(log).select(*PROJECTION_COLUMNS).withColumn("bucket", bucket)
         .hint("rebalance", "bucket").sortWithinPartitions("bucket", "initiated_at", "transaction_id")
         .observe(seen, F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").option("partitionOverwriteMode", "static").options(**PROJECTION_WRITE_OPTIONS)
         .partitionBy("bucket").parquet(self.projection_path))
        (self._latest(names).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.dimension_path))
        self._mark(self.derived_path, batches=covered)
        return int(seen.get.get("n") or 0)

    def quarantine(self, rejected: DataFrame, feed: str, batch: int) -> int:
        """Keep rejected wire rows with their errors, per batch; their number."""
        seen = Observation()
        rows = rejected.withColumn("batch_id", F.lit(batch).cast("int")).observe(seen, F.count(F.lit(1)).alias("n"))
        self._append(rows, self.quarantine_path, feed)
        return int(seen.get.get("n") or 0)

    def record_chunk(self, feed: str, batch: int, totals: dict) -> None:
        """What a chunk came to; a chunk that is done again replaces its record."""
        row = self.spark.range(1).select(*[F.lit(int(totals.get(n, 0))).cast("long").alias(n) for n in CHUNK_TOTALS],
                                         F.lit(batch).cast("int").alias("batch_id"))
        self._append(row, self.chunks_path, feed)

    def chunk_totals(self, feed: str) -> DataFrame:
        """One row: chunks of a feed and what they came to."""
        done = self._read(self.chunks_path)
        if done is None:
            return self.spark.range(1).select(*[F.lit(0).cast("long").alias(n) for n in ("chunks", *CHUNK_TOTALS)])
        return done.filter(F.col("feed") == feed).agg(
            F.count(F.lit(1)).alias("chunks"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in CHUNK_TOTALS])

    def _wipe(self, path: str) -> None:
        """Remove every file under ``path`` (a static overwrite with no rows)."""
        if self._read(path) is None:
            return
        nothing = self.spark.createDataFrame([], "x int, p int")
        (nothing.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("p").parquet(path))

    def truncate(self) -> None:
        """Wipe everything, the marks first.

        A static overwrite with no rows removes every partition and writes no
        file, so the next read sees an empty store.
        """
        for path in (self.complete_path, self.derived_path, self.log_path, self.names_path, self.projection_path,
                     self.dimension_path, self.quarantine_path, self.chunks_path, self.layout_path):
            self._wipe(path)
