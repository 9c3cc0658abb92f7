"""Oracle SQL for catalogue, identity, audits, profiles, validation, streaming."""

from __future__ import annotations

from tallyline.plans.oracle import _AS_OF, _CUT, EXPLAIN_SQL, PREFIX, RULE_SQL, _any, _money

_NEVER = RULE_SQL["processed_never_settled"].format(cut="TIMESTAMP '9999-12-31 00:00:00'")
_AGE = f"date_sub('second', coalesce(processed_at, initiated_at, first_settled_at), {_AS_OF})"


def _text(rule: str) -> str:
    """A rule's predicate as the catalogue prints it."""
    return RULE_SQL[rule].format(cut=":cutoff")[1:-1]


def _hours(sec: str) -> str:
    return f"sign({sec}) * floor((abs({sec}) + 18) / 36) / 100"


def extra_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # -- catalogue and identity ---------------------------------------------
    rows = "\n    UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{_text(n)}' AS predicate, '{EXPLAIN_SQL[n]}' AS description, "
        f"count(*) FILTER (WHERE {p.format(cut=_CUT)}) AS matched_count, "
        f"{_money(f'CASE WHEN {p.format(cut=_CUT)} THEN amount END')} AS matched_amount, {i} AS rule_order "
        f"FROM txn WHERE {_any(_CUT)}"
        for i, (n, p) in enumerate(RULE_SQL.items()))
    q["rules_catalogue"] = f"{PREFIX}\nSELECT rule, predicate, description, matched_count, matched_amount FROM ({rows}) ORDER BY rule_order"

    def money_if(cond: str) -> str:
        return _money(f"CASE WHEN {cond} THEN amount END")

    q["reconciliation_identity"] = f"""{PREFIX},
s AS (SELECT CAST({money_if("payment_status = 'processed'")} - {money_if("settlement_status = 'settled'")} AS DECIMAL(38,2)) AS unreconciled_amount,
             {money_if(RULE_SQL['processed_never_settled'].format(cut=_CUT))} AS never_settled_amount,
             {money_if(RULE_SQL['settled_despite_failure'].format(cut=_CUT))} AS despite_failure_amount,
             {money_if("payment_status = 'processed' AND settlement_status = 'unsettled'")} AS processed_unsettled_amount,
             {money_if("payment_status = 'failed' AND settlement_status = 'settled'")} AS failed_settled_amount,
             {money_if("payment_status = 'pending' AND settlement_status = 'settled'")} AS pending_settled_amount
      FROM txn)
SELECT *,
       unreconciled_amount = processed_unsettled_amount - failed_settled_amount - pending_settled_amount AS identity_holds,
       unreconciled_amount = never_settled_amount - despite_failure_amount AS short_form_holds
FROM s"""

    # -- audits ----------------------------------------------------------------
    q["audit_constraints"] = f"""{PREFIX}
SELECT transaction_id, 'negative_amount' AS violation FROM txn WHERE amount < 0
UNION ALL SELECT transaction_id, 'negative_count' FROM txn WHERE settled_event_count < 0 OR event_count < 0
UNION ALL SELECT transaction_id, 'no_evidence' FROM txn
    WHERE initiated_at IS NULL AND processed_at IS NULL AND failed_at IS NULL AND first_settled_at IS NULL"""
    q["audit_orphans"] = f"""{PREFIX}
SELECT 'transaction' AS kind, transaction_id AS id, merchant_id FROM txn
    WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants)
UNION ALL
SELECT 'event' AS kind, event_id AS id, merchant_id FROM log
    WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants)"""
    q["audit_invariants"] = f"""{PREFIX}
SELECT transaction_id,
       count(DISTINCT merchant_id) > 1 AS merchant_conflict,
       count(DISTINCT amount) > 1 AS amount_conflict,
       count(DISTINCT currency) > 1 AS currency_conflict,
       min(amount) AS min_amount, max(amount) AS max_amount
FROM log GROUP BY transaction_id
HAVING count(DISTINCT merchant_id) > 1 OR count(DISTINCT amount) > 1 OR count(DISTINCT currency) > 1"""
    q["audit_keys"] = f"""{PREFIX}
SELECT 'log_event_id' AS "check", event_id AS key, count(*) AS n FROM log GROUP BY event_id HAVING count(*) > 1
UNION ALL
SELECT 'projection_transaction_id', transaction_id, count(*) FROM txn GROUP BY transaction_id HAVING count(*) > 1
UNION ALL
SELECT 'event_in_two_transactions', event_id, CAST(2 AS BIGINT) FROM raw GROUP BY event_id
    HAVING count(DISTINCT transaction_id) > 1"""

    # -- profiles ----------------------------------------------------------------
    q["profile_shapes"] = f"""{PREFIX},
shapes AS (SELECT transaction_id, string_agg(event_type, '>' ORDER BY occurred_at, event_id) AS shape
           FROM log GROUP BY transaction_id)
SELECT shape, count(*) AS transactions FROM shapes GROUP BY shape ORDER BY transactions DESC, shape"""
    q["profile_matrix"] = f"""{PREFIX}
SELECT payment_status,
       count(*) FILTER (WHERE first_settled_at IS NULL) AS unsettled,
       count(*) FILTER (WHERE first_settled_at IS NOT NULL AND settled_event_count <= 1) AS settled_once,
       count(*) FILTER (WHERE first_settled_at IS NOT NULL AND settled_event_count > 1) AS settled_multi
FROM txn GROUP BY payment_status"""
    lag = "epoch_us(first_settled_at) - epoch_us(processed_at)"
    q["profile_lag"] = f"""{PREFIX},
l AS (SELECT {lag} AS lag FROM txn WHERE processed_at IS NOT NULL AND first_settled_at IS NOT NULL)
SELECT count(*) AS settled_after_processing,
       round(quantile_disc(lag, 0.5) / 3600000000.0, 6) AS p50_hours,
       round(quantile_disc(lag, 0.99) / 3600000000.0, 6) AS p99_hours,
       round(max(lag) / 3600000000.0, 6) AS max_hours
FROM l"""
    q["profile_unsettled_age"] = f"""{PREFIX},
a AS (SELECT {_AGE} AS age FROM txn WHERE {_NEVER})
SELECT count(*) AS never_settled, min(age) AS min_age_seconds, {_hours('min(age)')} AS min_age_hours FROM a"""
    q["profile_duplicates"] = f"""{PREFIX},
r AS (SELECT event_type, row_number() OVER (PARTITION BY event_id ORDER BY batch_id, pos) AS rn FROM raw)
SELECT event_type, count(*) AS duplicates FROM r WHERE rn > 1 GROUP BY event_type"""
    q["profile_naive_vs_dedup"] = f"""{PREFIX},
naive AS (SELECT count(*) AS n FROM (SELECT transaction_id FROM raw GROUP BY transaction_id
          HAVING count(*) FILTER (WHERE event_type = 'settled') > 1)),
dedup AS (SELECT count(*) AS n FROM txn WHERE settled_event_count > 1)
SELECT naive.n AS naive_duplicate_settlements, dedup.n AS dedup_duplicate_settlements,
       naive.n - dedup.n AS false_positives
FROM naive, dedup"""
    q["profile_ratio"] = f"""{PREFIX}
SELECT CAST(sum(event_count) AS BIGINT) AS events, count(*) AS transactions,
       round(avg(event_count), 6) AS events_per_transaction,
       max(event_count) AS max_events_per_transaction
FROM txn"""
    q["validate_errors"] = VALIDATE_SQL
    # Streaming ingest must converge to the batch rebuild.
    txn_cols = ("transaction_id, merchant_id, amount, currency, initiated_at, processed_at, failed_at, "
                "first_settled_at, last_settled_at, settled_event_count, event_count, first_event_at, "
                "last_event_at, payment_status, settlement_status, status")
    q["stream_transactions"] = f"{PREFIX}\nSELECT {txn_cols} FROM txn"
    q["stream_running_state"] = f"{PREFIX}\nSELECT {txn_cols} FROM txn"
    q["store_incremental"] = f"{PREFIX}\nSELECT {txn_cols} FROM txn"
    q["store_mixed_feeds"] = f"""{PREFIX}
SELECT {", ".join("t." + c.strip() for c in txn_cols.split(","))},
       m.merchant_name || CASE WHEN t.merchant_id IN (SELECT merchant_id FROM raw WHERE batch_id = 1) THEN ' (new)' ELSE '' END AS merchant_name
FROM txn t JOIN merchants m ON m.merchant_id = t.merchant_id"""
    q["ingest_labels_log"] = f"""{PREFIX}
SELECT event_id, batch_id, pos,
       CASE WHEN event_id % 2 = 0 OR row_number() OVER (PARTITION BY event_id ORDER BY batch_id, pos) > 1
            THEN 'duplicate' ELSE 'ingested' END AS status
FROM raw"""
    q["merchants_merge"] = f"""{PREFIX},
gone AS (SELECT -count(*) AS merchant_id FROM merchants WHERE merchant_id % 2 = 0)
SELECT merchant_id, merchant_name, merchant_id % 2 = 1 OR merchant_id % 4 = 0 AS changed FROM merchants
UNION ALL SELECT merchant_id, 'gone', false FROM gone"""
    one = "(SELECT min(transaction_id) FROM log)"
    detail = "concat_ws(',', " + ", ".join(f"CASE WHEN {p.format(cut=_CUT)} THEN '{n}' END" for n, p in RULE_SQL.items()) + ")"
    q["txn_lookup"] = f"{PREFIX}\nSELECT *, {detail} AS discrepancies FROM vw WHERE transaction_id = {one}"
    q["txn_history_one"] = f"""{PREFIX}
SELECT l.transaction_id, l.event_id, l.event_type, l.amount, l.currency, l.occurred_at, n.n_name AS merchant_name
FROM log l JOIN nation n ON n.n_nationkey = l.merchant_id WHERE l.transaction_id = {one}"""
    pages = " UNION ALL ".join(
        f'SELECT total, 50 AS "limit", {o} AS "offset", greatest(least(50, total - {o}), 0) AS returned, '
        f"{o} + greatest(least(50, total - {o}), 0) < total AS has_more FROM n" for o in (0, 1_000_000_000))
    q["discrepancy_page_meta"] = f"{PREFIX},\nn AS (SELECT count(*) AS total FROM txn WHERE {_any(_CUT)})\n{pages}"
    q["validate_json"] = f"""
SELECT pos, is_valid AND NOT broken AND k NOT IN (18, 19) AS is_valid,
       CAST(CASE WHEN broken THEN 8 WHEN k IN (18, 19) THEN 1 ELSE error_count END AS INTEGER) AS error_count,
       CASE WHEN broken THEN 'event_id' WHEN k = 18 THEN 'timestamp' WHEN k = 19 THEN 'merchant_name' ELSE first_error_field END AS first_error_field,
       CASE WHEN broken THEN 'missing' WHEN k = 18 THEN 'datetime_parsing' WHEN k = 19 THEN 'string_type' ELSE first_error_code END AS first_error_code
FROM (SELECT *, pos % 20 AS k, pos % 40 = 0 AS broken FROM ({VALIDATE_SQL}))"""
    q["audit_constraints_planted"] = f"""{PREFIX}
SELECT transaction_id, 'negative_amount' AS violation FROM txn WHERE transaction_id % 97 = 0
UNION ALL SELECT transaction_id, 'negative_count' FROM txn WHERE transaction_id % 89 = 0
UNION ALL SELECT transaction_id, 'no_evidence' FROM txn WHERE transaction_id % 83 = 0"""
    q["audit_orphans_planted"] = f"""{PREFIX}
SELECT 'transaction' AS kind, transaction_id AS id, merchant_id FROM txn WHERE merchant_id % 5 = 0
UNION ALL SELECT 'event', event_id, merchant_id FROM log WHERE merchant_id % 5 = 0"""
    q["audit_keys_planted"] = f"""{PREFIX}
SELECT 'log_event_id' AS "check", event_id AS key, CAST(2 AS BIGINT) AS n FROM log WHERE event_id % 91 = 0
UNION ALL SELECT 'projection_transaction_id', transaction_id, CAST(2 AS BIGINT) FROM txn WHERE transaction_id % 79 = 0
UNION ALL SELECT 'event_in_two_transactions', event_id, CAST(2 AS BIGINT) FROM raw WHERE batch_id = 1"""
    return q


_UUID = r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})$"
_DEC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"

VALIDATE_SQL = f"""
WITH src AS (
    SELECT e.event_id AS pos, e.event_id % 20 AS k, e.ts, e.user_id,
           e.user_id * 1000 + dayofyear(e.ts) AS txn_key,
           CASE e.event_type
               WHEN 'view' THEN 'payment_initiated' WHEN 'click' THEN 'payment_initiated'
               WHEN 'purchase' THEN 'payment_processed' WHEN 'error' THEN 'payment_failed'
               WHEN 'signup' THEN 'settled' ELSE e.event_type END AS mapped_type,
           CAST(CAST(e.value AS DECIMAL(14,2)) AS VARCHAR) AS amount_text,
           '00000000-0000-4000-8000-' || lpad(lower(hex(e.event_id)), 12, '0') AS event_uuid,
           n.n_name
    FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25
),
wire AS (
    SELECT pos,
           CASE WHEN k = 2 THEN 'not-a-uuid' WHEN k = 12 THEN upper(event_uuid) ELSE event_uuid END AS event_id,
           CASE WHEN k = 1 THEN 'banana' ELSE mapped_type END AS event_type,
           CASE WHEN k = 16 THEN NULL
                ELSE '00000000-0000-4000-9000-' || lpad(lower(hex(txn_key)), 12, '0') END AS transaction_id,
           CASE WHEN k = 6 THEN '' ELSE CAST(user_id % 25 AS VARCHAR) END AS merchant_id,
           CASE WHEN k = 14 THEN repeat('x', 256) ELSE n_name END AS merchant_name,
           CASE WHEN k = 3 THEN '-5.00' WHEN k = 7 THEN '1.239' WHEN k = 13 THEN NULL
                WHEN k = 15 THEN '1234567890123.00' WHEN k = 17 THEN '00' || amount_text
                ELSE amount_text END AS amount,
           CASE WHEN k = 4 THEN 'RUPEES' WHEN k = 8 THEN 'IN1' WHEN k = 10 THEN 'inr' ELSE 'INR' END AS currency,
           CASE WHEN k = 5 THEN 'yesterday'
                WHEN k = 11 THEN strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_text,
           CASE WHEN k = 9 THEN 1 ELSE 0 END AS n_extra
    FROM src
),
parsed AS (
    SELECT *,
           CASE WHEN regexp_matches(ts_text, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')
                THEN CAST(try_cast(ts_text AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
                ELSE try_cast(ts_text AS TIMESTAMP) END AS ts_value,
           length(regexp_replace(regexp_extract(regexp_replace(amount, '^[+-]', ''), '^([0-9]*)', 1), '^0+', '')) AS whole,
           length(regexp_replace(regexp_extract(regexp_replace(amount, '^[+-]', ''), '\\.([0-9]*)$', 1), '0+$', '')) AS places
    FROM wire
),
codes AS (
    SELECT *,
           CASE WHEN event_id IS NULL THEN 'missing'
                WHEN NOT regexp_matches(event_id, '{_UUID}') THEN 'uuid_parsing' END AS e1,
           CASE WHEN event_type IS NULL THEN 'missing'
                WHEN event_type NOT IN ('payment_initiated', 'payment_processed', 'payment_failed', 'settled')
                THEN 'enum' END AS e2,
           CASE WHEN transaction_id IS NULL THEN 'missing'
                WHEN NOT regexp_matches(transaction_id, '{_UUID}') THEN 'uuid_parsing' END AS e3,
           CASE WHEN merchant_id IS NULL THEN 'missing' WHEN length(merchant_id) < 1 THEN 'string_too_short'
                WHEN length(merchant_id) > 64 THEN 'string_too_long' END AS e4,
           CASE WHEN merchant_name IS NULL THEN 'missing' WHEN length(merchant_name) < 1 THEN 'string_too_short'
                WHEN length(merchant_name) > 255 THEN 'string_too_long' END AS e5,
           CASE WHEN amount IS NULL THEN 'missing'
                WHEN NOT regexp_matches(amount, '{_DEC}') THEN 'decimal_parsing'
                WHEN whole + places > 14 THEN 'decimal_max_digits'
                WHEN places > 2 THEN 'decimal_max_places'
                WHEN whole > 12 THEN 'decimal_whole_digits'
                WHEN starts_with(amount, '-') AND regexp_matches(regexp_replace(amount, '[-+.0]', '', 'g'), '[1-9]')
                THEN 'greater_than_equal' END AS e6,
           CASE WHEN currency IS NULL THEN 'missing' WHEN length(currency) < 3 THEN 'string_too_short'
                WHEN length(currency) > 3 THEN 'string_too_long'
                WHEN NOT regexp_matches(upper(currency), '^\\p{{L}}+$') THEN 'currency_code' END AS e7,
           CASE WHEN ts_text IS NULL THEN 'missing' WHEN ts_value IS NULL THEN 'datetime_parsing' END AS e8
    FROM parsed
)
SELECT pos,
       (e1 IS NULL AND e2 IS NULL AND e3 IS NULL AND e4 IS NULL AND e5 IS NULL AND e6 IS NULL
        AND e7 IS NULL AND e8 IS NULL AND n_extra = 0) AS is_valid,
       CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT + (e4 IS NOT NULL)::INT
            + (e5 IS NOT NULL)::INT + (e6 IS NOT NULL)::INT + (e7 IS NOT NULL)::INT + (e8 IS NOT NULL)::INT
            + n_extra AS INTEGER) AS error_count,
       CASE WHEN e1 IS NOT NULL THEN 'event_id' WHEN e2 IS NOT NULL THEN 'event_type'
            WHEN e3 IS NOT NULL THEN 'transaction_id' WHEN e4 IS NOT NULL THEN 'merchant_id'
            WHEN e5 IS NOT NULL THEN 'merchant_name' WHEN e6 IS NOT NULL THEN 'amount'
            WHEN e7 IS NOT NULL THEN 'currency' WHEN e8 IS NOT NULL THEN 'timestamp'
            WHEN n_extra > 0 THEN 'note' END AS first_error_field,
       coalesce(e1, e2, e3, e4, e5, e6, e7, e8, CASE WHEN n_extra > 0 THEN 'extra_forbidden' END) AS first_error_code,
       CASE WHEN e1 IS NULL OR e1 <> 'missing' AND regexp_matches(event_id, '{_UUID}') THEN
            regexp_replace(lower(regexp_replace(event_id, '-', '', 'g')),
                           '^([0-9a-f]{{8}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{12}})$',
                           '\\1-\\2-\\3-\\4-\\5') END AS event_id,
       CASE WHEN e3 IS NULL THEN
            regexp_replace(lower(regexp_replace(transaction_id, '-', '', 'g')),
                           '^([0-9a-f]{{8}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{12}})$',
                           '\\1-\\2-\\3-\\4-\\5') END AS transaction_id,
       CASE WHEN e6 IS NULL THEN CAST(try_cast(amount AS DECIMAL(38,10)) AS DECIMAL(14,2)) END AS amount,
       CASE WHEN e7 IS NULL THEN upper(currency) END AS currency,
       ts_value AS occurred_at
FROM codes
"""
