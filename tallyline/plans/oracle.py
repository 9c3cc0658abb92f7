"""Independent ANSI SQL (DuckDB dialect) for every registered query.

Written separately from the DataFrame code so the two implementations can
disagree: the driver runs both at sf0.01 and compares row counts, schemas and
value hashes. The CTE prefix re-derives deliveries, log, projection and
merchant names from the raw ``events`` and ``nation`` views.
"""

from __future__ import annotations

from tallyline.plans import catalog as C

_CUT = "TIMESTAMP '2024-01-30 00:00:00'"          # AS_OF - 24 h
_CUT_SLA4 = "TIMESTAMP '2024-01-30 20:00:00'"     # AS_OF - 4 h
_CUT_EARLY = "TIMESTAMP '2024-01-14 00:00:00'"    # AS_OF_EARLY - 24 h
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

PREFIX = """
WITH raw AS (
    SELECT e.event_id,
           e.user_id * 1000 + dayofyear(e.ts) AS transaction_id,
           e.user_id % 25 AS merchant_id,
           n.n_name AS merchant_name,
           CASE e.event_type
               WHEN 'view' THEN 'payment_initiated'
               WHEN 'click' THEN 'payment_initiated'
               WHEN 'purchase' THEN 'payment_processed'
               WHEN 'error' THEN 'payment_failed'
               WHEN 'signup' THEN 'settled'
               ELSE e.event_type END AS event_type,
           CAST(e.value AS DECIMAL(14,2)) AS amount,
           'INR' AS currency,
           e.ts AS occurred_at,
           c.batch_id,
           e.event_id AS pos
    FROM events e
    JOIN (VALUES (0), (1)) AS c(batch_id) ON c.batch_id = 0 OR e.event_id % 50 = 0
    LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
),
log AS (
    SELECT event_id, transaction_id, merchant_id, event_type, amount, currency,
           occurred_at, batch_id, pos
    FROM raw
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_id, pos) = 1
),
proj AS (
    SELECT transaction_id,
           min(merchant_id) AS merchant_id,
           min(amount) AS amount,
           min(currency) AS currency,
           min(occurred_at) FILTER (WHERE event_type = 'payment_initiated') AS initiated_at,
           min(occurred_at) FILTER (WHERE event_type = 'payment_processed') AS processed_at,
           min(occurred_at) FILTER (WHERE event_type = 'payment_failed') AS failed_at,
           min(occurred_at) FILTER (WHERE event_type = 'settled') AS first_settled_at,
           max(occurred_at) FILTER (WHERE event_type = 'settled') AS last_settled_at,
           count(*) FILTER (WHERE event_type = 'settled') AS settled_event_count,
           count(*) AS event_count,
           min(occurred_at) AS first_event_at,
           max(occurred_at) AS last_event_at
    FROM log
    GROUP BY transaction_id
),
txn AS (
    SELECT *,
           CASE WHEN failed_at IS NOT NULL THEN 'failed'
                WHEN processed_at IS NOT NULL THEN 'processed'
                ELSE 'pending' END AS payment_status,
           CASE WHEN first_settled_at IS NOT NULL THEN 'settled' ELSE 'unsettled' END AS settlement_status,
           CASE WHEN first_settled_at IS NOT NULL THEN 'settled'
                WHEN failed_at IS NOT NULL THEN 'failed'
                WHEN processed_at IS NOT NULL THEN 'processed'
                ELSE 'pending' END AS status
    FROM proj
),
merchants AS (
    SELECT merchant_id, merchant_name
    FROM raw
    QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY batch_id DESC, pos DESC) = 1
),
vw AS (
    SELECT t.transaction_id, t.merchant_id, m.merchant_name, t.amount, t.currency,
           t.status, t.payment_status, t.settlement_status,
           t.initiated_at, t.processed_at, t.failed_at,
           t.first_settled_at, t.last_settled_at,
           t.event_count, t.settled_event_count, t.last_event_at
    FROM txn t JOIN merchants m ON m.merchant_id = t.merchant_id
)
"""

RULE_SQL = {
    "processed_never_settled": ("(processed_at IS NOT NULL AND first_settled_at IS NULL "
                                "AND failed_at IS NULL AND processed_at < {cut})"),
    "settled_despite_failure": "(failed_at IS NOT NULL AND first_settled_at IS NOT NULL)",
    "duplicate_settlement": "(settled_event_count > 1)",
    "stuck_pending": ("(initiated_at IS NOT NULL AND processed_at IS NULL AND failed_at IS NULL "
                      "AND first_settled_at IS NULL AND initiated_at < {cut})"),
    "settled_without_processing": ("(first_settled_at IS NOT NULL AND processed_at IS NULL "
                                   "AND failed_at IS NULL)"),
}

EXPLAIN_SQL = {
    "processed_never_settled": "Payment was processed but has not settled within the SLA window.",
    "settled_despite_failure": "Settlement was recorded for a payment that failed.",
    "duplicate_settlement": "Transaction was settled more than once by distinct events.",
    "stuck_pending": "Payment was initiated but never processed, failed or settled.",
    "settled_without_processing": "Settlement was recorded without any preceding payment processing.",
}

VIEW_COLS = """transaction_id, merchant_id, merchant_name, amount, currency, status, payment_status,
    settlement_status, initiated_at, processed_at, failed_at, first_settled_at, last_settled_at,
    event_count, settled_event_count, last_event_at"""


def _any(cut: str) -> str:
    return "(" + " OR ".join(p.format(cut=cut) for p in RULE_SQL.values()) + ")"


def _rules_string(cut: str) -> str:
    arms = ", ".join(f"CASE WHEN {p.format(cut=cut)} THEN '{n}' END" for n, p in RULE_SQL.items())
    return f"concat_ws(',', {arms})"


def _detail_string(cut: str) -> str:
    arms = ", ".join(f"CASE WHEN {p.format(cut=cut)} THEN '{EXPLAIN_SQL[n]}' END" for n, p in RULE_SQL.items())
    return f"concat_ws(' ', {arms})"


_AGE = f"date_sub('second', coalesce(processed_at, initiated_at, first_settled_at), {_AS_OF})"


def _discrepancy_rows(where: str, cut: str = _CUT) -> str:
    return f"""{PREFIX}
SELECT {VIEW_COLS},
       {_rules_string(cut)} AS discrepancies,
       {_detail_string(cut)} AS detail,
       {_AGE} AS age_seconds,
       sign({_AGE}) * floor((abs({_AGE}) + 18) / 36) / 100 AS age_hours
FROM vw
WHERE {where}
ORDER BY initiated_at DESC NULLS LAST, transaction_id DESC"""


def _money(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS DECIMAL(38,2))"


_METRICS = f"""count(*) AS transaction_count,
       {_money('amount')} AS total_amount,
       count(*) FILTER (WHERE payment_status = 'processed') AS processed_count,
       count(*) FILTER (WHERE payment_status = 'failed') AS failed_count,
       count(*) FILTER (WHERE payment_status = 'pending') AS pending_count,
       count(*) FILTER (WHERE settlement_status = 'settled') AS settled_count,
       count(*) FILTER (WHERE settlement_status = 'unsettled') AS unsettled_count,
       {_money("CASE WHEN payment_status = 'processed' THEN amount END")} AS expected_settlement_amount,
       {_money("CASE WHEN settlement_status = 'settled' THEN amount END")} AS settled_amount,
       CAST({_money("CASE WHEN payment_status = 'processed' THEN amount END")}
            - {_money("CASE WHEN settlement_status = 'settled' THEN amount END")} AS DECIMAL(38,2))
           AS unreconciled_amount"""

_DIM_SQL = {
    "merchant": ["t.merchant_id", "m.merchant_name"],
    "date": ["CAST(t.initiated_at AS DATE)"],
    "status": ["t.status"],
    "payment_status": ["t.payment_status"],
    "settlement_status": ["t.settlement_status"],
}
_DIM_NAMES = {
    "merchant": ["merchant_id", "merchant_name"],
    "date": ["date"],
    "status": ["status"],
    "payment_status": ["payment_status"],
    "settlement_status": ["settlement_status"],
}


def _summary(dims: list[str], totals: bool = False) -> str:
    exprs = [e for d in dims for e in _DIM_SQL[d]]
    names = [n for d in dims for n in _DIM_NAMES[d]]
    select = "".join(f"{e} AS \"{n}\", " for e, n in zip(exprs, names))
    join = "JOIN merchants m ON m.merchant_id = t.merchant_id" if "merchant" in dims else ""
    if not dims:
        extra = ", TRUE AS is_total" if totals else ""
        return f"{PREFIX}\nSELECT {_METRICS}{extra}\nFROM txn t"
    if totals:
        group = f"GROUP BY GROUPING SETS (({', '.join(exprs)}), ())"
        extra = f",\n       grouping({', '.join(exprs)}) <> 0 AS is_total"
    else:
        group = f"GROUP BY {', '.join(exprs)}"
        extra = ""
    order = ", ".join(f"\"{n}\" ASC NULLS FIRST" for n in names)
    return f"{PREFIX}\nSELECT {select}{_METRICS}{extra}\nFROM txn t {join}\n{group}\nORDER BY {order}"


def _rule_long(cut: str) -> str:
    aggs = ",\n       ".join(
        f"count(*) FILTER (WHERE {p.format(cut=cut)}) AS c{i},\n       "
        f"{_money(f'CASE WHEN {p.format(cut=cut)} THEN amount END')} AS a{i}"
        for i, p in enumerate(RULE_SQL.values()))
    unions = "\n    UNION ALL ".join(
        f"SELECT '{n}' AS type, c{i} AS count, a{i} AS total_amount, {i} AS rule_order FROM w"
        for i, n in enumerate(RULE_SQL))
    return f"""{PREFIX},
w AS (SELECT {aggs}
      FROM txn WHERE {_any(cut)}),
l AS ({unions})"""


def _counts(cut: str) -> str:
    return f"""{_rule_long(cut)}
SELECT type, count, total_amount FROM l WHERE count > 0 ORDER BY count DESC, rule_order"""


def _page(order: str, limit: int, offset: int = 0, where: str = "TRUE") -> str:
    off = f" OFFSET {offset}" if offset else ""
    lim = f" LIMIT {limit}" if limit else ""
    return f"{PREFIX}\nSELECT {VIEW_COLS} FROM vw WHERE {where}\nORDER BY {order}{lim}{off}"


_INIT_DESC = "initiated_at DESC NULLS LAST, transaction_id DESC"


def core_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["transactions"] = f"{PREFIX}\nSELECT * FROM txn"
    q["event_log"] = f"{PREFIX}\nSELECT * FROM log"
    q["ingest_labels"] = f"""{PREFIX}
SELECT event_id, batch_id, pos, transaction_id, event_type,
       CASE WHEN row_number() OVER (PARTITION BY event_id ORDER BY batch_id, pos) = 1
            THEN 'ingested' ELSE 'duplicate' END AS status
FROM raw"""
    q["ingest_totals"] = f"""{PREFIX}
SELECT count(*) AS received, count(DISTINCT event_id) AS ingested,
       count(*) - count(DISTINCT event_id) AS duplicates
FROM raw"""
    q["merchants"] = f"{PREFIX}\nSELECT merchant_id, merchant_name FROM merchants"
    q["rebuild_count"] = f"{PREFIX}\nSELECT count(*) AS transactions_rebuilt FROM txn"
    q["table_counts"] = f"""{PREFIX}
SELECT (SELECT count(*) FROM log) AS events,
       (SELECT count(*) FROM txn) AS transactions,
       (SELECT count(*) FROM merchants) AS merchants"""
    q["txn_list_default"] = _page(_INIT_DESC, C.PAGE_LIMIT)
    q["txn_sort_amount"] = _page("amount DESC NULLS LAST, transaction_id DESC", C.PAGE_LIMIT)
    q["txn_sort_settled_asc"] = _page("first_settled_at ASC NULLS FIRST, transaction_id ASC", C.PAGE_LIMIT)
    q["txn_page2"] = _page(_INIT_DESC, C.PAGE_LIMIT, C.PAGE2_OFFSET)
    q["txn_page2_by_key"] = q["txn_page2"]
    q["txn_page_meta"] = f"""{PREFIX}
SELECT total, 50 AS "limit", 50 AS "offset",
       CAST(greatest(least(50, total - 50), 0) AS BIGINT) AS returned,
       50 + greatest(least(50, total - 50), 0) < total AS has_more
FROM (SELECT count(*) AS total FROM txn)"""
    q["txn_filter_axes"] = _page(_INIT_DESC, 0, where="payment_status = 'failed' AND settlement_status = 'settled'")
    q["txn_filter_status"] = _page(_INIT_DESC, 0, where="status = 'processed'")
    q["txn_filter_merchant"] = _page(_INIT_DESC, 0, where=f"merchant_id = {C.FILTER_MERCHANT}")
    q["txn_filter_dates"] = _page(
        "initiated_at ASC NULLS FIRST, transaction_id ASC", 0,
        where=f"initiated_at >= TIMESTAMP '{C.DATE_FROM}' AND initiated_at < TIMESTAMP '{C.DATE_TO}'")
    q["txn_detail"] = f"{PREFIX}\nSELECT {VIEW_COLS}, {_rules_string(_CUT)} AS discrepancies FROM vw"
    q["txn_history_all"] = f"""{PREFIX}
SELECT transaction_id, event_id, event_type, amount, currency, occurred_at FROM log
ORDER BY transaction_id, occurred_at, event_id"""

    for name, dims, totals in (
        ("summary_merchant", ["merchant"], False),
        ("summary_date", ["date"], False),
        ("summary_status", ["status"], False),
        ("summary_merchant_date", ["merchant", "date"], False),
        ("summary_date_status", ["date", "status"], False),
        ("summary_axes", ["payment_status", "settlement_status"], False),
        ("summary_with_totals", ["merchant"], True),
        ("summary_total", [], False),
    ):
        q[name] = _summary(dims, totals)

    q["discrepancy_list"] = _discrepancy_rows(_any(_CUT))
    q["discrepancy_page"] = f"""{_discrepancy_rows(_any(_CUT))}
LIMIT 50"""
    q["discrepancy_page"] = f"""SELECT p.*, c.total_count FROM ({q['discrepancy_page']}) p
CROSS JOIN ({PREFIX} SELECT count(*) AS total_count FROM txn WHERE {_any(_CUT)}) c"""
    q["discrepancy_counts"] = _counts(_CUT)
    q["discrepancy_counts_sla4"] = _counts(_CUT_SLA4)
    q["discrepancy_counts_asof"] = _counts(_CUT_EARLY)
    for name, pred in RULE_SQL.items():
        q[f"rule_{name}"] = _discrepancy_rows(pred.format(cut=_CUT))
    dates = f"initiated_at >= TIMESTAMP '{C.DATE_FROM}' AND initiated_at < TIMESTAMP '{C.DATE_TO}'"
    combined = f"merchant_id = {C.FILTER_MERCHANT} AND {dates}"
    q["summary_filtered"] = f"""{PREFIX}
SELECT CAST(t.initiated_at AS DATE) AS "date", {_METRICS}
FROM txn t
WHERE t.merchant_id = {C.FILTER_MERCHANT} AND t.initiated_at >= TIMESTAMP '{C.DATE_FROM}'
  AND t.initiated_at < TIMESTAMP '{C.DATE_TO}'
GROUP BY CAST(t.initiated_at AS DATE)
ORDER BY "date" ASC NULLS FIRST"""
    q["discrepancy_filtered"] = _discrepancy_rows(f"{combined} AND {_any(_CUT)}")
    q["discrepancy_counts_filtered"] = _counts(_CUT).replace(
        f"FROM txn WHERE {_any(_CUT)}", f"FROM txn WHERE {combined} AND {_any(_CUT)}")
    q["txn_filter_combined_page"] = _page("amount ASC NULLS FIRST, transaction_id ASC", 20, 5,
                                          where=f"status = 'settled' AND {dates}")
    q["txn_sort_processed_asc"] = _page("processed_at ASC NULLS FIRST, transaction_id ASC", C.PAGE_LIMIT)
    q["txn_sort_last_event_desc"] = _page("last_event_at DESC NULLS LAST, transaction_id DESC", C.PAGE_LIMIT)
    return q


def oracle_sql() -> dict[str, str]:
    from tallyline.plans import extra_oracle, ledger_oracle

    out = core_sql()
    out.update(extra_oracle.extra_sql())
    out.update(ledger_oracle.ledger_sql())
    return out
