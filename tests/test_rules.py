from __future__ import annotations

import itertools
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.functions.rules import PREDICATE_TEXT, RULES, Horizon, age_hours, ts_literal
from tallyline.operators import ingest, projection, reports
from tests.conftest import AS_OF, BASE, Factory

SCENARIOS = {
    # name: (events as (type, minutes), expected rule list)
    "healthy": ([("payment_initiated", 0), ("payment_processed", 5), ("settled", 180)], ""),
    "clean_failure": ([("payment_initiated", 0), ("payment_failed", 10)], ""),
    "never_settled": ([("payment_initiated", 0), ("payment_processed", 5)], "processed_never_settled"),
    "despite_failure": ([("payment_initiated", 0), ("payment_failed", 10), ("settled", 200)],
                        "settled_despite_failure"),
    "double_settlement": ([("payment_initiated", 0), ("payment_processed", 5), ("settled", 180),
                           ("settled", 200)], "duplicate_settlement"),
    "stuck": ([("payment_initiated", 0)], "stuck_pending"),
    "settled_only": ([("settled", 200)], "settled_without_processing"),
    "multi_breach": ([("payment_initiated", 0), ("payment_failed", 10), ("settled", 200), ("settled", 205)],
                     "settled_despite_failure,duplicate_settlement"),
}


def _view(spark, f: Factory):
    d = f.df(spark)
    return reports.transaction_view(projection.rebuild(d), ingest.latest_merchant_names(d))


def test_rule_truth_table(spark):
    f = Factory()
    for name, (events, _) in SCENARIOS.items():
        for t, m in events:
            f.event(t, name, m)
    rows = reports.transaction_detail(_view(spark, f), Horizon.of(AS_OF).cutoff).collect()
    got = {r["transaction_id"]: r["discrepancies"] for r in rows}
    assert got == {k: v for k, (_, v) in SCENARIOS.items()}


@pytest.mark.parametrize("hours,sla,broken", [(1, None, False), (23, None, False), (24, None, False),
                                              (25, None, True), (6, 4, True)])
def test_sla_boundary(spark, hours, sla, broken):
    f = Factory()
    f.event("payment_initiated", "t", 0)
    f.event("payment_processed", "t", 0)
    listed = reports.list_discrepancies(_view(spark, f), BASE + timedelta(hours=hours), sla).count()
    assert listed == (1 if broken else 0)


def test_sla_range_checked():
    with pytest.raises(ValueError):
        Horizon.of(AS_OF, 9000)
    with pytest.raises(ValueError):
        Horizon.of(AS_OF, -1)


def test_naive_and_aware_as_of_agree():
    from datetime import timezone

    aware = (AS_OF + timedelta(hours=5, minutes=30)).replace(tzinfo=timezone(timedelta(hours=5, minutes=30)))
    assert Horizon.of(aware).cutoff == Horizon.of(AS_OF).cutoff


def test_arrival_order_converges(spark):
    events = [("payment_initiated", 0), ("payment_processed", 5), ("settled", 180), ("settled", 200)]
    results = set()
    orders = list(itertools.permutations(range(4)))
    random.Random(1).shuffle(orders)
    for order in orders[:6]:
        f = Factory()
        for i in order:
            f.event(events[i][0], "t", events[i][1], event_id=f"e{i}")
        r = projection.rebuild(f.df(spark)).first()
        results.add((r["initiated_at"], r["processed_at"], r["first_settled_at"], r["last_settled_at"],
                     r["settled_event_count"], r["status"]))
    assert len(results) == 1


def test_unknown_transaction_accepted(spark):
    f = Factory()
    f.event("settled", "never-seen", 10)
    r = projection.rebuild(f.df(spark)).first()
    assert (r["payment_status"], r["settlement_status"], r["status"]) == ("pending", "settled", "settled")


def test_failed_beats_processed(spark):
    f = Factory()
    f.event("payment_processed", "t", 5)
    f.event("payment_failed", "t", 6)
    r = projection.rebuild(f.df(spark)).first()
    assert r["payment_status"] == "failed" and r["status"] == "failed"


def test_settled_before_processed_is_clean(spark):
    f = Factory()
    f.event("payment_initiated", "t", 0)
    f.event("settled", "t", 1)
    f.event("payment_processed", "t", 5)
    assert reports.list_discrepancies(_view(spark, f), AS_OF).count() == 0


def test_value_reconciliation_and_exact_money(spark):
    f = Factory()
    for i, amt in enumerate(["0.10", "0.20", "0.30"]):
        f.happy_path(f"ok{i}", amount=amt)
    f.event("payment_initiated", "bad", 0, amount="5.00")
    f.event("payment_failed", "bad", 1, amount="5.00")
    f.event("settled", "bad", 2, amount="5.00")
    d = f.df(spark)
    s = reports.reconciliation_summary(projection.rebuild(d), None, "").first()
    assert s["expected_settlement_amount"] == Decimal("0.60")
    assert s["settled_amount"] == Decimal("5.60")
    assert s["unreconciled_amount"] == Decimal("-5.00")  # negative gap is a signal
    ident = reports.reconciliation_identity(projection.rebuild(d), AS_OF).first()
    assert ident["identity_holds"] and ident["unreconciled_amount"] == Decimal("-5.00")


def test_predicate_text_matches_builders(spark):
    cut = "TIMESTAMP_NTZ '2026-02-01 00:00:00'"
    rows = []
    stamps = [None, BASE, BASE + timedelta(days=40)]
    for ini, pro, fail, settle, n in itertools.product(stamps, stamps, stamps, stamps[:2], [0, 1, 2]):
        rows.append((ini, pro, fail, settle, n))
    df = spark.createDataFrame(rows, "initiated_at timestamp_ntz, processed_at timestamp_ntz, "
                                     "failed_at timestamp_ntz, first_settled_at timestamp_ntz, "
                                     "settled_event_count long")
    for name, fn in RULES.items():
        text = PREDICATE_TEXT[name].replace(":cutoff", cut)
        diff = df.filter(F.coalesce(fn(ts_literal("2026-02-01 00:00:00")), F.lit(False))
                         != F.coalesce(F.expr(text), F.lit(False))).count()
        assert diff == 0, name


@pytest.mark.parametrize("seconds,hours", [(18, 0.01), (17, 0.0), (3600, 1.0), (2146716, 596.31),
                                           (-18, -0.01), (-19, -0.01), (0, 0.0)])
def test_age_hours_rounds_half_up_on_integers(spark, seconds, hours):
    got = spark.range(1).select(age_hours(F.lit(seconds).cast("long")).alias("h")).first()["h"]
    assert got == pytest.approx(hours)


def test_discrepancy_counts_drop_zero_and_sort(spark):
    f = Factory()
    for i in range(3):
        f.event("payment_initiated", f"s{i}", 0)
    f.event("payment_initiated", "n", 0)
    f.event("payment_processed", "n", 5)
    out = reports.discrepancy_counts(projection.rebuild(f.df(spark)), AS_OF).collect()
    assert [(r["type"], r["count"]) for r in out] == [("stuck_pending", 3), ("processed_never_settled", 1)]


def test_unknown_rule_rejected(spark):
    f = Factory()
    f.event("payment_initiated", "t", 0)
    with pytest.raises(KeyError):
        reports.list_discrepancies(_view(spark, f), AS_OF, rule_name="banana")
