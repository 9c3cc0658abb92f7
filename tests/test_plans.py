"""Plan-shape checks: the properties the design relies on at scale.

These read Spark's physical plans (AQE off, so the static plan is visible)
for the registered queries and assert on what must or must not appear.
"""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyline.operators import ingest, projection
from tallyline.plans.catalog import registry
from tallyline.sources import driver_tables

SF = "/root/testdata/sf0.001"
STREAMING = {"stream_transactions", "stream_running_state", "store_incremental", "store_mixed_feeds"}  # write at build time
# Windows over counts: one row per occupied minute of lag, never rows.
OVER_COUNTS = {"profile_lag"}


def _plan(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = {name: E.queries()[name] for name in registry()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = {name: _plan(spark, fn(spark, SF)) for name, fn in qs.items() if name not in STREAMING}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return out


def test_no_window_operator_anywhere(plans):
    # Windows would gather a whole partition key (or everything) into one task.
    offenders = {n for n, p in plans.items() if re.search(r"\bWindow(GroupLimit)?\b", p)}
    assert offenders == OVER_COUNTS


def test_no_python_row_udf(plans):
    offenders = [n for n, p in plans.items() if "BatchEvalPython" in p]
    assert offenders == []


def test_pages_are_top_k(plans):
    for name in ("txn_list_default", "txn_sort_amount", "txn_sort_settled_asc", "txn_page2", "discrepancy_page"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_page_total_is_one_row_not_a_global_window(plans):
    p = plans["discrepancy_page"]
    assert "BroadcastNestedLoopJoin" in p and "Window" not in p


def test_dedup_and_pivot_combine_map_side(spark):
    d = driver_tables.deliveries(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(spark, projection.rebuild(d))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Two exchanges (event_id, then transaction_id), each fed by a partial aggregate.
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", p)
    assert exchanges == ["transaction_id", "event_id"]
    assert p.count("partial_min") >= 2


def test_names_unused_means_no_dimension_join(spark):
    d = driver_tables.deliveries(spark, SF)
    p = _plan(spark, ingest.dedupe_events(d))
    assert "nation" not in p and "Join" not in p


def test_date_filter_reaches_the_scan(spark):
    from tallyline.plans.catalog import Recon
    from tallyline.operators import reports
    from tallyline.operators.reports import TxnFilters

    r = Recon(spark, SF)
    df = reports.list_transactions(r.txn, TxnFilters(date_from="2024-01-10", date_to="2024-01-20"),
                                   limit=None, merchants=r.merchants)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(initiated_at", p)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(initiated_a", p)  # plan text truncates long lists


def test_scans_read_only_needed_columns(spark):
    from tallyline.plans.catalog import Recon
    from tallyline.operators import reports

    r = Recon(spark, SF)
    p = _plan(spark, reports.page_meta(r.txn))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all(s.count(":") <= 1 for s in schemas)


@pytest.mark.parametrize("name", ["transactions", "discrepancy_counts", "summary_merchant_date",
                                  "ingest_labels", "profile_shapes"])
def test_results_do_not_depend_on_partitioning(spark, name):
    import hashlib

    def digest():
        rows = E.queries()[name](spark, SF).collect()
        return hashlib.md5("\n".join(sorted(repr(tuple(r)) for r in rows)).encode()).hexdigest()

    base = digest()
    for parts, aqe in (("1", "true"), ("37", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            assert digest() == base, (parts, aqe)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_probe_too_large_to_broadcast_passes_a_bloom_filter(spark, tmp_path):
    """The log's rows are filtered by the batch's keys before the shuffle, and
    what is found is the same."""
    from tallyline.operators.ingest import PROBE_SETTINGS, known_event_ids, probe_keys
    from tallyline.session import settings

    path = str(tmp_path / "log")
    spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("event_id")).write.parquet(path)
    log = spark.read.parquet(path)
    batch = log.filter("event_id < '08'").unionByName(spark.range(-50, 0).select(F.md5(F.col("id").cast("string")).alias("event_id")))
    batch = batch.unionByName(batch)
    want = known_event_ids(batch, log).count()
    assert want == log.filter("event_id < '08'").count() > 0
    forced = {**PROBE_SETTINGS, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    keys = probe_keys(batch).persist()
    try:
        with settings(spark, forced):
            found = known_event_ids(batch, log, keys)
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "might_contain" in plan and "bloom_filter_agg" in plan
            assert found.count() == want
        # small keys are broadcast, without a filter
        small = known_event_ids(batch, log, keys)._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" not in small
    finally:
        keys.unpersist()
