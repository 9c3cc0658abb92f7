"""Cross-view consistency on the driver data: every view is built from the
same rule definitions and projection, so they must agree with each other."""

from __future__ import annotations

import __spark_entry__ as E
from tallyline.schema import RULE_NAMES

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return E.queries()[name](spark, SF).collect()


def test_rule_lists_counts_and_catalogue_agree(spark):
    counts = {r["type"]: r["count"] for r in _rows(spark, "discrepancy_counts")}
    catalogue = {r["rule"]: r["matched_count"] for r in _rows(spark, "rules_catalogue")}
    listed = _rows(spark, "discrepancy_list")
    for name in RULE_NAMES:
        per_rule = len(_rows(spark, f"rule_{name}"))
        assert catalogue[name] == per_rule
        assert counts.get(name, 0) == per_rule
        assert sum(1 for r in listed if name in r["discrepancies"].split(",")) == per_rule
    page = _rows(spark, "discrepancy_page")
    assert page and all(r["total_count"] == len(listed) for r in page)


def test_summaries_and_identity_agree(spark):
    total = _rows(spark, "summary_total")[0]
    by_merchant = _rows(spark, "summary_merchant")
    with_totals = _rows(spark, "summary_with_totals")
    assert sum(r["transaction_count"] for r in by_merchant) == total["transaction_count"]
    assert sum(r["unreconciled_amount"] for r in by_merchant) == total["unreconciled_amount"]
    grand = [r for r in with_totals if r["is_total"]][0]
    assert grand["total_amount"] == total["total_amount"]
    ident = _rows(spark, "reconciliation_identity")[0]
    assert ident["identity_holds"] and ident["unreconciled_amount"] == total["unreconciled_amount"]
    counts = _rows(spark, "table_counts")[0]
    assert counts["transactions"] == total["transaction_count"] == _rows(spark, "rebuild_count")[0]["transactions_rebuilt"]
    totals = _rows(spark, "ingest_totals")[0]
    assert totals["ingested"] == counts["events"]
