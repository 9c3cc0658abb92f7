"""The named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

``Recon`` wires the shared intermediates. Ingest-path queries (the pivot,
dedup, labels, totals) compute from the raw deliveries every time. Read-path
queries (lists, summaries, discrepancies, audits, profiles) read the stored
log and projection, the way the service reads its tables: the store is loaded
once per Spark application from the driver tables (a written table under the
application's checkpoint folder) and then scanned with pruning. Nothing is
collected: every query is a lazy plan whose work grows with the tables.
"""

from __future__ import annotations

import hashlib
import os
import threading
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.rules import Horizon
from tallyline.operators import ingest, projection, reports
from tallyline.operators.reports import TxnFilters
from tallyline.schema import LOG_COLUMNS
from tallyline.session import ensure_checkpoint_dir
from tallyline.sources import driver_tables
from tallyline.sources.store import EventStore, buckets_for

# Parameters of the registered queries (fixed so results are reproducible).
AS_OF = "2024-01-31 00:00:00"
AS_OF_EARLY = "2024-01-15 00:00:00"
SLA_HOURS = 24
SLA_SHORT = 4
PAGE_LIMIT = 50
PAGE2_OFFSET = 50
FILTER_MERCHANT = 7
DATE_FROM = "2024-01-10 00:00:00"
DATE_TO = "2024-01-20 00:00:00"

_LOAD_LOCK = threading.Lock()
_LOADED: dict[tuple[str, str], dict] = {}   # (application, root): the store and its tables
STORE_ROOT_CONF = "spark.tallyline.storeRoot"


class Recon:
    """Lazily built intermediates over one set of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def deliveries(self) -> DataFrame:
        return driver_tables.deliveries(self.spark, self.sf_dir)

    # -- ingest path: always from the raw deliveries ---------------------------
    @cached_property
    def raw_log(self) -> DataFrame:
        return ingest.dedupe_events(self.deliveries)

    @cached_property
    def raw_txn(self) -> DataFrame:
        return projection.transactions(self.raw_log)

    # -- read path: the stored log, projection and dimension ---------------------
    @cached_property
    def store(self) -> EventStore:
        # A shared, persistent location can be named in the session
        # (spark.tallyline.storeRoot); a complete store found there is reused
        # across applications. Otherwise the store lives in this application's
        # checkpoint folder and is loaded once per application.
        key = hashlib.sha1(os.path.abspath(self.sf_dir).encode()).hexdigest()[:16]
        base = self.spark.conf.get(STORE_ROOT_CONF, None) or f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tallyline"
        root = f"{base.rstrip('/')}/store-{key}"
        with _LOAD_LOCK:
            key = (self.spark.sparkContext.applicationId, root)
            if key not in _LOADED:
                # The source's row count (from its footers) names it and sizes the buckets.
                rows = driver_tables.read_table(self.spark, self.sf_dir, "events").count()
                source = f"{os.path.abspath(self.sf_dir)}: {rows} events"
                store = EventStore(self.spark, root)
                if not store.is_complete(source):
                    store = EventStore(self.spark, root, buckets=buckets_for(rows))
                    store.truncate()
                    store.load(self.deliveries, source)
                _LOADED[key] = {"store": store, "log": store.log(), "txn": store.transactions(), "merchants": store.merchants()}
        return _LOADED[key]["store"]

    def _stored(self, name: str) -> DataFrame:
        """A table of the loaded store. Nobody writes to it while the
        application runs, so its file listing is read once."""
        store = self.store
        return _LOADED[self.spark.sparkContext.applicationId, store.root][name]

    @cached_property
    def log(self) -> DataFrame:
        return self._stored("log").select(*LOG_COLUMNS, "received_at")

    @cached_property
    def txn(self) -> DataFrame:
        return self._stored("txn")

    @cached_property
    def merchants(self) -> DataFrame:
        return self._stored("merchants")


    @property
    def cutoff(self):
        return Horizon.of(AS_OF, SLA_HOURS).cutoff


QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def register(fn: Callable[[Recon], DataFrame]) -> Callable[[Recon], DataFrame]:
        _REGISTRY[name] = lambda spark, sf_dir, _fn=fn: _fn(Recon(spark, sf_dir))
        return fn
    return register


def registry() -> dict[str, QueryFn]:
    # Importing the modules that register queries fills the registry.
    from tallyline.plans import extra_queries, ledger_queries, store_queries  # noqa: F401

    return dict(_REGISTRY)


# ---------------------------------------------------------------------------
# Ingest and projection
# ---------------------------------------------------------------------------

@query("transactions")
def q_transactions(r: Recon) -> DataFrame:
    return r.raw_txn


@query("event_log")
def q_event_log(r: Recon) -> DataFrame:
    return r.raw_log


@query("ingest_labels")
def q_ingest_labels(r: Recon) -> DataFrame:
    return ingest.label_deliveries(r.deliveries).select(
        "event_id", "batch_id", "pos", "transaction_id", "event_type", "status")


@query("ingest_totals")
def q_ingest_totals(r: Recon) -> DataFrame:
    return ingest.ingest_totals(r.deliveries)


@query("merchants")
def q_merchants(r: Recon) -> DataFrame:
    return ingest.merge_merchants(None, r.deliveries).select("merchant_id", "merchant_name")


@query("rebuild_count")
def q_rebuild_count(r: Recon) -> DataFrame:
    return projection.rebuild(r.deliveries).agg(F.count(F.lit(1)).alias("transactions_rebuilt"))


@query("table_counts")
def q_table_counts(r: Recon) -> DataFrame:
    """G1: three one-row counts side by side (one-row cross joins)."""
    return (r.store.log().agg(F.count(F.lit(1)).alias("events"))
            .crossJoin(r.txn.agg(F.count(F.lit(1)).alias("transactions")))
            .crossJoin(r.merchants.agg(F.count(F.lit(1)).alias("merchants"))))


# ---------------------------------------------------------------------------
# Listing, paging, filters, detail
# ---------------------------------------------------------------------------

@query("txn_list_default")
def q_txn_list_default(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, limit=PAGE_LIMIT, merchants=r.merchants)


@query("txn_sort_amount")
def q_txn_sort_amount(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, sort_by="amount", sort_dir="desc", limit=PAGE_LIMIT, merchants=r.merchants)


@query("txn_sort_settled_asc")
def q_txn_sort_settled_asc(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, sort_by="settled_at", sort_dir="asc", limit=PAGE_LIMIT, merchants=r.merchants)


@query("txn_page2")
def q_txn_page2(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, limit=PAGE_LIMIT, offset=PAGE2_OFFSET, merchants=r.merchants)


@query("txn_page_meta")
def q_txn_page_meta(r: Recon) -> DataFrame:
    return reports.page_meta(r.txn, limit=PAGE_LIMIT, offset=PAGE2_OFFSET)


@query("txn_filter_axes")
def q_txn_filter_axes(r: Recon) -> DataFrame:
    f = TxnFilters(payment_status="failed", settlement_status="settled")
    return reports.list_transactions(r.txn, f, limit=None, merchants=r.merchants)


@query("txn_filter_status")
def q_txn_filter_status(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, TxnFilters(status="processed"), limit=None, merchants=r.merchants)


@query("txn_filter_merchant")
def q_txn_filter_merchant(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, TxnFilters(merchant_id=FILTER_MERCHANT), limit=None, merchants=r.merchants)


@query("txn_filter_dates")
def q_txn_filter_dates(r: Recon) -> DataFrame:
    f = TxnFilters(date_from=DATE_FROM, date_to=DATE_TO)
    return reports.list_transactions(r.txn, f, sort_by="initiated_at", sort_dir="asc", limit=None, merchants=r.merchants)


@query("txn_detail")
def q_txn_detail(r: Recon) -> DataFrame:
    return reports.transaction_detail(r.txn, r.cutoff, merchants=r.merchants)


@query("txn_history_all")
def q_txn_history_all(r: Recon) -> DataFrame:
    # received_at is arrival time (non-deterministic); the compared view omits it.
    return reports.transaction_history(r.log.drop("received_at"))


# ---------------------------------------------------------------------------
# Summaries
# ---------------------------------------------------------------------------

def _summary(group_by: str, with_totals: bool = False):
    def build(r: Recon) -> DataFrame:
        return reports.reconciliation_summary(r.txn, r.merchants, group_by, with_totals=with_totals)
    return build


for _name, _dims, _tot in (
    ("summary_merchant", "merchant", False),
    ("summary_date", "date", False),
    ("summary_status", "status", False),
    ("summary_merchant_date", "merchant,date", False),
    ("summary_date_status", "date,status", False),
    ("summary_axes", "payment_status,settlement_status", False),
    ("summary_with_totals", "merchant", True),
    ("summary_total", "", False),
):
    query(_name)(_summary(_dims, _tot))


# ---------------------------------------------------------------------------
# Discrepancies
# ---------------------------------------------------------------------------

@query("discrepancy_list")
def q_discrepancy_list(r: Recon) -> DataFrame:
    return reports.list_discrepancies(r.txn, AS_OF, SLA_HOURS, merchants=r.merchants)


@query("discrepancy_page")
def q_discrepancy_page(r: Recon) -> DataFrame:
    return reports.discrepancy_page(r.txn, AS_OF, SLA_HOURS, limit=PAGE_LIMIT, merchants=r.merchants)


@query("discrepancy_counts")
def q_discrepancy_counts(r: Recon) -> DataFrame:
    return reports.discrepancy_counts(r.txn, AS_OF, SLA_HOURS)


@query("discrepancy_counts_sla4")
def q_discrepancy_counts_sla4(r: Recon) -> DataFrame:
    return reports.discrepancy_counts(r.txn, AS_OF, SLA_SHORT)


@query("discrepancy_counts_asof")
def q_discrepancy_counts_asof(r: Recon) -> DataFrame:
    return reports.discrepancy_counts(r.txn, AS_OF_EARLY, SLA_HOURS)


def _rule_query(rule_name: str):
    def build(r: Recon) -> DataFrame:
        return reports.list_discrepancies(r.txn, AS_OF, SLA_HOURS, rule_name=rule_name, merchants=r.merchants)
    return build


for _rule in ("processed_never_settled", "settled_despite_failure", "duplicate_settlement",
              "stuck_pending", "settled_without_processing"):
    query(f"rule_{_rule}")(_rule_query(_rule))


@query("rules_catalogue")
def q_rules_catalogue(r: Recon) -> DataFrame:
    return reports.rules_catalogue(r.txn, AS_OF, SLA_HOURS)


@query("reconciliation_identity")
def q_reconciliation_identity(r: Recon) -> DataFrame:
    return reports.reconciliation_identity(r.txn, AS_OF, SLA_HOURS)


# ---------------------------------------------------------------------------
# Filter combinations on the summary, discrepancy and list views
# ---------------------------------------------------------------------------
FILTER_COMBINED = TxnFilters(merchant_id=FILTER_MERCHANT, date_from=DATE_FROM, date_to=DATE_TO)


@query("summary_filtered")
def q_summary_filtered(r: Recon) -> DataFrame:
    return reports.reconciliation_summary(r.txn, r.merchants, "date", filters=FILTER_COMBINED)


@query("discrepancy_filtered")
def q_discrepancy_filtered(r: Recon) -> DataFrame:
    return reports.list_discrepancies(r.txn, AS_OF, SLA_HOURS, filters=FILTER_COMBINED, merchants=r.merchants)


@query("discrepancy_counts_filtered")
def q_discrepancy_counts_filtered(r: Recon) -> DataFrame:
    return reports.discrepancy_counts(r.txn, AS_OF, SLA_HOURS, filters=FILTER_COMBINED)


@query("txn_filter_combined_page")
def q_txn_filter_combined_page(r: Recon) -> DataFrame:
    f = TxnFilters(status="settled", date_from=DATE_FROM, date_to=DATE_TO)
    return reports.list_transactions(r.txn, f, sort_by="amount", sort_dir="asc", limit=20, offset=5,
                                     merchants=r.merchants)


@query("txn_sort_processed_asc")
def q_txn_sort_processed_asc(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, sort_by="processed_at", sort_dir="asc", limit=PAGE_LIMIT,
                                     merchants=r.merchants)


@query("txn_sort_last_event_desc")
def q_txn_sort_last_event_desc(r: Recon) -> DataFrame:
    return reports.list_transactions(r.txn, sort_by="last_event_at", sort_dir="desc", limit=PAGE_LIMIT,
                                     merchants=r.merchants)
