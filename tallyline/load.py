"""Load a JSON event file into a store and print the load report.

    python -m tallyline.load --file events.json --store /shared/recon [--truncate]
        [--chunk-size 1000] [--on-error fail|quarantine] [--lines]
        [--resume NAME [--files-per-chunk 1] [--most-chunks N]]

Validates first (``fail``: one bad row loads nothing, the first five are
reported by position), then ingests in one distributed job. Every load is a
feed of its own in the store. A failed run can simply be re-run:
events already stored come back as duplicates. ``--chunk-size`` is
accepted for callers that pass it; Spark's tasks are the chunks.

``--resume NAME`` loads a folder in chunks of whole files, each landed before
the next begins. The checkpoint of the file source, kept in the store under the
name, is the ledger of chunks: a load that broke off goes on with the chunk
that was not finished, and the report covers the chunks of all its runs.
"""

from __future__ import annotations

import argparse
import sys
import time
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from tallyline.operators import validate as V
from tallyline.session import get_session
from tallyline.sources.json_events import read_event_array, read_event_lines
from tallyline.sources.store import EventStore
from tallyline.streaming.ingest import ingest_batch_fn, json_documents_stream, json_lines_stream


def load_file(spark: SparkSession, path: str, store: EventStore, chunk_size: int | None = None,
              on_error: str = "fail", lines: bool = False, feed: str | None = None) -> dict:
    """Validate a file, ingest it, return totals.

    ``feed`` names the load; a retry under the same name replaces the earlier
    attempt. By default each call is a new feed. ``chunk_size`` is accepted and
    checked, but the job is one ingest: Spark's tasks are its chunks, and a
    failed task is retried alone.
    """
    if chunk_size is not None and chunk_size < 1:
        raise ValueError("chunk_size must be >= 1")
    checked = V.validate(read_event_lines(spark, path) if lines else read_event_array(spark, path)).persist()
    try:
        deliveries = V.gate(checked, on_error)
        feed = feed or f"load:{uuid.uuid4().hex}"
        if on_error == "quarantine":
            store.quarantine(V.quarantine(checked), feed, 0)
        return store.ingest(deliveries, 0, feed)
    finally:
        checked.unpersist()


class Paused(Exception):
    """Raised inside a load that was to stop after some chunks."""


def load_chunks(spark: SparkSession, path: str, store: EventStore, name: str, files_per_chunk: int = 1,
                on_error: str = "fail", lines: bool = True, most_chunks: int | None = None) -> dict:
    """A5: load a folder chunk by chunk, going on where an earlier call under
    the same ``name`` ended, however it ended.

    A chunk is ``files_per_chunk`` files. With ``fail`` the whole folder is
    validated before the first chunk lands. ``most_chunks`` ends this call after
    so many chunks. Returns the totals of all chunks so far.
    """
    if files_per_chunk < 1 or most_chunks is not None and most_chunks < 1:
        raise ValueError("a load needs at least one file a chunk and one chunk")
    feed = f"load:{name}"
    if on_error == "fail" and not store.chunk_totals(feed).first()["chunks"]:
        V.gate(V.validate(read_event_lines(spark, path) if lines else read_event_array(spark, path)), "fail")
    land = ingest_batch_fn(store, wire=True, on_error=on_error, feed=feed, report=True)
    begun = 0

    def chunk(batch: DataFrame, number: int) -> None:
        nonlocal begun
        if begun == most_chunks:
            raise Paused(f"{begun} chunks done")
        begun += 1
        land(batch, number)

    stream = json_lines_stream if lines else json_documents_stream
    query = (stream(spark, path, files_per_chunk).writeStream.foreachBatch(chunk)
             .option("checkpointLocation", f"{store.root}/loads/{name}").trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if begun != most_chunks:
            raise
    return store.chunk_totals(feed).first().asDict()


def table_counts(store: EventStore) -> dict:
    log, merchants = store.log(), store.merchants()
    try:
        txn = store.transactions().count()
    except FileNotFoundError:
        txn = 0
    return {"events": 0 if log is None else log.count(), "transactions": txn,
            "merchants": 0 if merchants is None else merchants.count()}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--file", required=True)
    ap.add_argument("--store", required=True)
    ap.add_argument("--chunk-size", type=int, default=None)
    ap.add_argument("--truncate", action="store_true")
    ap.add_argument("--on-error", choices=("fail", "quarantine"), default="fail")
    ap.add_argument("--lines", action="store_true", help="input is JSON Lines (splittable)")
    ap.add_argument("--resume", metavar="NAME", help="load a folder in chunks, going on where NAME ended")
    ap.add_argument("--files-per-chunk", type=int, default=1)
    ap.add_argument("--most-chunks", type=int, default=None)
    args = ap.parse_args(argv)

    spark = get_session(app_name="tallyline-load")
    store = EventStore(spark, args.store)
    if args.truncate:
        store.truncate()
    t0 = time.perf_counter()
    try:
        if args.resume:
            totals = load_chunks(spark, args.file, store, args.resume, args.files_per_chunk, args.on_error, args.lines,
                                 args.most_chunks)
        else:
            totals = load_file(spark, args.file, store, args.chunk_size, args.on_error, args.lines)
    except V.ValidationFailed as err:
        print(f"error: {err}", file=sys.stderr)
        return 1
    elapsed = time.perf_counter() - t0
    report = {**totals, **{f"stored {k}": v for k, v in table_counts(store).items()}}
    print(f"{args.file} -> {args.store}: {elapsed:.2f} s")
    for name, n in report.items():
        print(f"{name:>20} {n:>12,}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
