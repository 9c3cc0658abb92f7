"""tallyline: payment-event reconciliation as Spark DataFrame jobs.

Layers:

* ``sources``    - read deliveries (driver tables, JSON files) and the stored log.
* ``functions``  - Column builders: status axes, discrepancy rules, wire checks.
* ``operators``  - DataFrame -> DataFrame steps: validate, dedup, project,
                   report, audit, profile.
* ``plans``      - the named queries the driver runs, plus their DuckDB oracle.
* ``streaming``  - Structured Streaming ingest through ``foreachBatch``.

Typical use::

    from tallyline import EventStore, TxnFilters, get_session, reports
    spark = get_session()
    store = EventStore(spark, "/shared/recon")
    txn, names = store.transactions(), store.merchants()
    reports.list_discrepancies(txn, as_of="2024-01-31", merchants=names, limit=50)
"""

from tallyline.operators import audits, ingest, profile, projection, reports, validate
from tallyline.operators.reports import TxnFilters
from tallyline.session import get_session
from tallyline.sources.store import EventStore

__all__ = [
    "EventStore", "TxnFilters", "audits", "get_session", "ingest", "profile", "projection",
    "reports", "validate",
]
