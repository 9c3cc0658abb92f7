"""Structured Streaming ingest: micro-batches through the batch operators."""
