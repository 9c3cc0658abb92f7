from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyline.operators import validate as V
from tallyline.sources.json_events import event_to_json, read_event_array, read_event_lines

GOOD = {
    "event_id": "3F2504E0-4F89-11D3-9A0C-0305E82C3301",
    "event_type": "payment_initiated",
    "transaction_id": "a1b2c3d4e5f60718293a4b5c6d7e8f90",
    "merchant_id": "merchant_1",
    "merchant_name": "QuickMart",
    "amount": "1500.50",
    "currency": "inr",
    "timestamp": "2026-01-08T17:30:00+05:30",
}


def _write(tmp_root, name, payload: str) -> str:
    path = os.path.join(tmp_root, name)
    with open(path, "w") as fh:
        fh.write(payload)
    return path


@pytest.mark.parametrize("field,value,code", [
    ("event_type", "banana", "enum"),
    ("event_id", "not-a-uuid", "uuid_parsing"),
    ("amount", "-5.00", "greater_than_equal"),
    ("amount", "1.239", "decimal_max_places"),
    ("amount", "1234567890123.00", "decimal_whole_digits"),
    ("amount", "12345678901234.5", "decimal_max_digits"),
    ("amount", "abc", "decimal_parsing"),
    ("currency", "RUPEES", "string_too_long"),
    ("currency", "IN1", "currency_code"),
    ("timestamp", "yesterday", "datetime_parsing"),
    ("merchant_id", "", "string_too_short"),
    ("merchant_name", "x" * 256, "string_too_long"),
])
def test_invalid_events_rejected(spark, tmp_root, field, value, code):
    bad = dict(GOOD, **{field: value})
    wire = read_event_array(spark, _write(tmp_root, "one.json", json.dumps(bad)))
    row = V.validate(wire).first()
    assert not row["is_valid"]
    assert (row["first_error_field"], row["first_error_code"]) == (field, code)


def test_unknown_and_missing_fields(spark, tmp_root):
    extra = dict(GOOD, note="hi")
    missing = {k: v for k, v in GOOD.items() if k != "amount"}
    wire = read_event_array(spark, _write(tmp_root, "two.json", json.dumps([extra, missing])))
    rows = V.validate(wire).orderBy("pos").collect()
    assert [(r["first_error_field"], r["first_error_code"]) for r in rows] == [
        ("note", "extra_forbidden"), ("amount", "missing")]


def test_valid_event_canonicalised(spark, tmp_root):
    numeric = dict(GOOD, amount=12.5)  # a JSON number keeps its digits
    wire = read_event_array(spark, _write(tmp_root, "ok.json", json.dumps([GOOD, numeric])))
    rows = V.accepted(V.validate(wire)).orderBy("pos").collect()
    assert len(rows) == 2
    r = rows[0]
    assert r["event_id"] == "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
    assert r["transaction_id"] == "a1b2c3d4-e5f6-0718-293a-4b5c6d7e8f90"
    assert r["currency"] == "INR" and str(r["amount"]) == "1500.50"
    assert r["occurred_at"].isoformat() == "2026-01-08T12:00:00"  # offset converted to UTC
    assert str(rows[1]["amount"]) == "12.50"


def test_gate_all_or_nothing(spark, tmp_root):
    rows = [GOOD] + [dict(GOOD, event_type="banana")] * 7
    wire = read_event_array(spark, _write(tmp_root, "batch.json", json.dumps(rows)))
    checked = V.validate(wire)
    with pytest.raises(V.ValidationFailed) as err:
        V.gate(checked, "fail")
    assert err.value.bad_rows == 7 and len(err.value.examples) == 5
    assert err.value.examples[0][0] == 1
    assert V.gate(checked, "quarantine").count() == 1
    assert V.quarantine(checked).count() == 7


def test_json_lines_and_round_trip(spark, tmp_root):
    lines = "\n".join(json.dumps(dict(GOOD, event_id=f"00000000-0000-4000-8000-{i:012x}")) for i in range(5))
    wire = read_event_lines(spark, _write(tmp_root, "events.jsonl", lines + "\n"))
    typed = V.accepted(V.validate(wire))
    assert typed.count() == 5
    back = event_to_json(typed).collect()
    again = read_event_lines(spark, _write(tmp_root, "again.jsonl", "\n".join(r["value"] for r in back)))
    assert V.accepted(V.validate(again)).count() == 5


def test_driver_wire_fixture_counts(spark):
    from tallyline.sources.driver_tables import wire_deliveries

    v = V.validate(wire_deliveries(spark, "/root/testdata/sf0.001"))
    codes = {r["first_error_code"]: r["n"] for r in
             v.groupBy("first_error_code").count().withColumnRenamed("count", "n").collect()}
    for code in ("enum", "uuid_parsing", "greater_than_equal", "string_too_long", "datetime_parsing",
                 "string_too_short", "decimal_max_places", "currency_code", "extra_forbidden", "missing",
                 "decimal_whole_digits"):
        assert codes.get(code, 0) > 0, code


def test_load_file_in_chunks_is_resumable(spark, tmp_root):
    from tallyline.load import load_file, table_counts
    from tallyline.sources.store import EventStore

    events = [dict(GOOD, event_id=f"00000000-0000-4000-8000-{i:012x}",
                   transaction_id=f"00000000-0000-4000-9000-{i // 2:012x}") for i in range(10)]
    events.append(events[0])  # a replay inside the file
    path = _write(tmp_root, "load.json", json.dumps(events))
    store = EventStore(spark, os.path.join(tmp_root, "store"), buckets=2)
    totals = load_file(spark, path, store, chunk_size=4)
    assert totals == {"received": 11, "ingested": 10, "duplicates": 1}
    assert table_counts(store) == {"events": 10, "transactions": 5, "merchants": 1}
    again = load_file(spark, path, store, chunk_size=4)  # re-running is safe
    assert again == {"received": 11, "ingested": 0, "duplicates": 11}
    bad = _write(tmp_root, "bad.json", json.dumps([GOOD, dict(GOOD, currency="RUPEES")]))
    with pytest.raises(V.ValidationFailed):
        load_file(spark, bad, store)
    assert table_counts(store)["events"] == 10


def test_loader_cli_reports_and_fails_cleanly(spark, tmp_root, capsys):
    from tallyline.load import main

    events = [dict(GOOD, event_id=f"00000000-0000-4000-8000-{i:012x}") for i in range(3)]
    good = _write(tmp_root, "cli.json", json.dumps(events + [events[1]]))
    store = os.path.join(tmp_root, "cli-store")
    assert main(["--file", good, "--store", store, "--truncate"]) == 0
    out = capsys.readouterr().out
    counts = {line.rsplit(None, 1)[0].strip(): line.split()[-1] for line in out.splitlines()[1:]}
    assert (counts["received"], counts["ingested"], counts["duplicates"], counts["stored events"]) == ("4", "3", "1", "3")
    bad = _write(tmp_root, "cli-bad.json", json.dumps([dict(GOOD, amount="-1.00")]))
    assert main(["--file", bad, "--store", store]) == 1
    assert "nothing was loaded" in capsys.readouterr().err


def test_amounts_in_exponent_form_and_uuid_spellings(spark):
    """Against Python's own Decimal and UUID."""
    import uuid
    from decimal import Decimal

    from tallyline.functions import checks as K

    def law(text):
        sign, digits, last = Decimal(text).normalize().as_tuple()
        places = max(-last, 0)
        size = max(len(digits) + max(last, 0), places) if any(digits) else 0
        if size > 14:
            return "decimal_max_digits"
        if any(digits) and places > 2:
            return "decimal_max_places"
        if any(digits) and size - places > 12:
            return "decimal_whole_digits"
        return "greater_than_equal" if sign and any(digits) else None

    texts = ["1e3", "1.5E-1", "15e-3", "1E11", "1E12", "1e14", "123456.7e1", "0e99999", "-0e5", "-1e2", "+2.50e+1", "1e-99999",
             "00.10e1", "1234567890.12e2", "1000e-3", "0.00", "12.30", "999999999999.99", "1e99999999999", ".5e1", "5.e0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.e, r.v) for r in rows.select("t", K.amount_error(F.col("t")).alias("e"), K.canonical_amount(F.col("t")).alias("v")).collect()}
    for t in texts:
        want = law(t) if abs(int(t.lower().partition("e")[2] or 0)) < 10**6 else "decimal_max_digits"
        assert got[t][0] == want, (t, got[t])
        assert want or got[t][1] == Decimal(t), t
    for t in ("1e", "e5", "1e5.0", "nan", "Infinity", "1 e5"):
        assert spark.range(1).select(K.amount_error(F.lit(t))).first()[0] == "decimal_parsing"
    plain = "A0000000-0000-4000-8000-00000000000f"
    good = [plain, plain.lower(), "{" + plain + "}", "urn:uuid:" + plain, plain.replace("-", "")]
    bad = ["{" + plain, plain + "}", "URN:UUID:" + plain, "urn:uuid:" + plain.replace("-", ""), "{" + plain.replace("-", "") + "}", plain[:-1]]
    ids = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", K.canonical_uuid(F.col("t")).alias("u"))
    assert {r.t: r.u for r in ids.collect()} == {**{t: str(uuid.UUID(t)) for t in good}, **dict.fromkeys(bad)}
