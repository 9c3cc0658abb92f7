from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = datetime(2026, 1, 8, 12, 0, 0)
AS_OF = BASE + timedelta(days=30)

DELIVERY_DDL = ("event_id string, transaction_id string, merchant_id string, merchant_name string, "
                "event_type string, amount decimal(14,2), currency string, occurred_at timestamp_ntz, "
                "batch_id int, pos long")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tallyline.session import configure

    builder = (SparkSession.builder.master("local[4]").appName("tallyline-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="tallyline-test-")


class Factory:
    """Builds deliveries like the reference's scenario helpers."""

    def __init__(self):
        self.rows = []
        self._n = 0

    def event(self, event_type: str, txn: str, minutes: float = 0, event_id: str | None = None,
              merchant_id: str = "merchant_1", merchant_name: str = "QuickMart",
              amount: str = "1500.50", batch_id: int = 0, currency: str = "INR"):
        self._n += 1
        eid = event_id or f"e{self._n:06d}"
        self.rows.append((eid, txn, merchant_id, merchant_name, event_type, Decimal(amount), currency,
                          BASE + timedelta(minutes=minutes), batch_id, len(self.rows)))
        return eid

    def happy_path(self, txn: str, **kw):
        self.event("payment_initiated", txn, 0, **kw)
        self.event("payment_processed", txn, 5, **kw)
        self.event("settled", txn, 180, **kw)

    def df(self, spark):
        return spark.createDataFrame(self.rows, DELIVERY_DDL)


@pytest.fixture()
def factory():
    return Factory()
