"""Oracle SQL for loads in chunks, statistics, joined histories, deep pages and
state digests."""

from __future__ import annotations

from tallyline.plans.extra_oracle import VALIDATE_SQL
from tallyline.plans.oracle import PREFIX, VIEW_COLS


def _statistics() -> str:
    from tallyline.plans.ledger_queries import STATISTICS_COLUMNS

    rows = []
    for c in STATISTICS_COLUMNS:
        time = c.endswith("_at")
        number, moment = ("NULL", f"{{f}}({c})") if time else (f"{{f}}({c})", "NULL")
        parts = [f"CAST({x.format(f=f)} AS {t}) AS {f}_{n}" for x, t, n in ((number, "DECIMAL(38,2)", "number"), (moment, "TIMESTAMP", "time"))
                 for f in ("min", "max")]
        rows.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, {', '.join(parts)} FROM proj")
    return "\nUNION ALL ".join(rows)


def ledger_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["load_resumed"] = f"""
WITH v AS ({VALIDATE_SQL}),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos % 50 = 0) AS twice, count(*) FILTER (WHERE is_valid) AS good,
             count(*) FILTER (WHERE is_valid AND pos % 50 = 0) AS good_twice,
             count(DISTINCT transaction_id) FILTER (WHERE is_valid) AS transactions FROM v)
SELECT CAST(3 AS BIGINT) AS chunks, good + good_twice AS received, good AS ingested, good_twice AS duplicates,
       n + twice - good - good_twice AS rejected, transactions, good AS events FROM s"""
    q["table_statistics"] = f"{PREFIX}\n{_statistics()}"
    q["txn_with_history"] = f"""{PREFIX}
SELECT t.transaction_id, t.status, 0 AS slice, 1 AS slices, t.event_count, CAST(count(*) AS INTEGER) AS events_here,
       string_agg(concat_ws(' ', l.event_id, l.event_type, l.amount, strftime(l.occurred_at, '%Y-%m-%d %H:%M:%S')), '; '
                  ORDER BY l.occurred_at, l.event_id) AS history
FROM txn t JOIN log l ON l.transaction_id = t.transaction_id GROUP BY t.transaction_id, t.status, t.event_count"""
    q["txn_page_deep"] = f"""{PREFIX}
SELECT {VIEW_COLS} FROM (SELECT *, row_number() OVER (ORDER BY initiated_at DESC NULLS LAST, transaction_id DESC) - 1 AS place,
                                   count(*) OVER () AS n FROM vw)
WHERE place >= floor(n * 0.9) AND place < floor(n * 0.9) + 50"""
    columns = ("transaction_id", "merchant_id", "amount", "currency", "settled_event_count", "event_count")
    text = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    half = "CAST(sum(CAST('0x' || substr(m, {at}, 16) AS HUGEINT)) AS DECIMAL(38,0))"
    q["state_fingerprint"] = f"""{PREFIX},
rows_ AS (SELECT md5({text}) AS m FROM proj),
sums AS (SELECT count(*) AS rows, {half.format(at=1)} AS high_sum, {half.format(at=17)} AS low_sum FROM rows_)
SELECT s AS state, sums.* FROM sums, (VALUES ('first'), ('replayed'), ('again')) AS x(s)"""
    return q
