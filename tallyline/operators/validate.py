"""Validation with quarantine (2.B): wire rows -> (accepted, quarantine).

One pass of column expressions builds ``errors array<struct<field, code,
message>>`` per row, in field order, then unknown fields; no UDF. ``gate``
implements the all-or-nothing loader mode: any bad row fails the batch and
the first five are reported by position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import checks as K
from tallyline.schema import DELIVERY_COLUMNS

FIELD_CHECKS = (
    ("event_id", K.uuid_error),
    ("event_type", K.event_type_error),
    ("transaction_id", K.uuid_error),
    ("merchant_id", K.merchant_id_error),
    ("merchant_name", K.merchant_name_error),
    ("amount", K.amount_error),
    ("currency", K.currency_error),
    ("timestamp", K.timestamp_error),
)


ERROR_ARRAY_TYPE = "array<struct<field:string,code:string,message:string>>"


class ValidationFailed(ValueError):
    def __init__(self, bad_rows: int, examples: list[tuple]):
        self.bad_rows, self.examples = bad_rows, examples
        lines = [f"  invalid event at index {pos}: {msg}" for pos, msg in examples]
        super().__init__("\n".join(lines + [f"{bad_rows} invalid event(s); nothing was loaded"]))


def _messages() -> Column:
    return F.create_map(*[x for k, v in K.MESSAGES.items() for x in (F.lit(k), F.lit(v))])


def _code_col(field: str) -> str:
    return f"_code_{field}"


def error_array(wire: DataFrame) -> Column:
    """Errors from the per-field code columns (computed once each by ``validate``)."""
    msgs = _messages()
    per_field = []
    for field, _ in FIELD_CHECKS:
        code = F.col(_code_col(field))
        err = F.struct(F.lit(field).alias("field"), code.alias("code"), F.element_at(msgs, code).alias("message"))
        per_field.append(F.when(code.isNotNull(), F.array(err)).otherwise(F.array().cast(ERROR_ARRAY_TYPE)))
    # flatten of 0/1-element arrays keeps the whole expression in generated
    # code (array_compact would become a lambda filter evaluated row by row).
    errors = F.flatten(F.array(*per_field))
    if "extra_keys" in wire.columns:
        keys = F.col("extra_keys")
        extras = F.transform(keys, lambda k: F.struct(
            k.alias("field"), F.lit("extra_forbidden").alias("code"),
            F.lit(K.MESSAGES["extra_forbidden"]).alias("message")))
        # The lambda only runs for rows that carry unknown fields.
        errors = F.when(F.size(keys) > 0, F.concat(errors, extras)).otherwise(errors)
    return errors


def _typed(wire: DataFrame, field: str, code: Column) -> Column:
    """A field's error code; a JSON value of the wrong type is an error of its
    own, before its text is looked at."""
    if "wrong_types" not in wire.columns:
        return code
    wrong = F.lit("decimal_type" if field == "amount" else "string_type")
    return F.when(F.array_contains("wrong_types", field), wrong).otherwise(code)


def validate(wire: DataFrame) -> DataFrame:
    """Add ``errors``, ``is_valid``, the first error, and typed canonical fields.

    Each field's code (and the parsed timestamp) is materialised as a column
    first and then referenced, so no check is evaluated more than once per row.
    Count, validity and first error come from the codes directly; the error
    array is only built for rejected rows.
    """
    ts = "_parsed_ts"
    coded = wire.withColumn(ts, K.parsed_timestamp(F.col("timestamp")))
    coded = coded.withColumns({
        _code_col(f): _typed(wire, f, K.timestamp_error(F.col("timestamp"), F.col(ts)) if f == "timestamp" else check(F.col(f)))
        for f, check in FIELD_CHECKS
    })
    codes = [F.col(_code_col(f)) for f, _ in FIELD_CHECKS]
    n_extra = F.size(F.col("extra_keys")) if "extra_keys" in wire.columns else F.lit(0)
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in codes]) + n_extra
    first_field = None
    for (field, _), c in zip(FIELD_CHECKS, codes):
        first_field = F.when(c.isNotNull(), F.lit(field)) if first_field is None \
            else first_field.when(c.isNotNull(), F.lit(field))
    if "extra_keys" in wire.columns:
        first_field = first_field.when(n_extra > 0, F.get(F.col("extra_keys"), 0))
        first_code = F.coalesce(*codes, F.when(n_extra > 0, F.lit("extra_forbidden")))
    else:
        first_code = F.coalesce(*codes)
    coded = coded.withColumns({"error_count": count, "first_error_field": first_field,
                               "first_error_code": first_code})
    ok = lambda f: F.col(_code_col(f)).isNull()
    return coded.withColumns({
        "is_valid": F.col("error_count") == 0,
        "errors": F.when(F.col("error_count") > 0, error_array(coded)).otherwise(F.array().cast(ERROR_ARRAY_TYPE)),
        "first_error": F.when(F.col("error_count") > 0, F.concat(
            F.col("first_error_field"), F.lit(": "), F.element_at(_messages(), F.col("first_error_code")))),
        "v_event_id": F.when(ok("event_id"), K.hyphenated_uuid(F.col("event_id"))),
        "v_transaction_id": F.when(ok("transaction_id"), K.hyphenated_uuid(F.col("transaction_id"))),
        "v_amount": F.when(ok("amount"), K.exact_amount(F.col("amount"))),
        "v_currency": F.when(ok("currency"), F.upper(F.col("currency"))),
        "v_occurred_at": F.col(ts),
    }).drop(ts, *[_code_col(f) for f, _ in FIELD_CHECKS])


def accepted(validated: DataFrame) -> DataFrame:
    """Valid rows as typed deliveries (``timestamp`` renamed to ``occurred_at``)."""
    return validated.filter("is_valid").select(
        F.col("v_event_id").alias("event_id"), F.col("v_transaction_id").alias("transaction_id"),
        "merchant_id", "merchant_name", "event_type", F.col("v_amount").alias("amount"),
        F.col("v_currency").alias("currency"), F.col("v_occurred_at").alias("occurred_at"),
        "batch_id", "pos",
    ).select(*DELIVERY_COLUMNS)


def quarantine(validated: DataFrame) -> DataFrame:
    """Rejected rows: the raw wire fields plus every error."""
    keep = [c for c in validated.columns if not c.startswith("v_") and c not in ("is_valid",)]
    return validated.filter(~F.col("is_valid")).select(*keep)


def gate(validated: DataFrame, on_error: str = "fail") -> DataFrame:
    """``fail`` raises if any row is invalid (nothing loads); ``quarantine``
    passes the valid rows through. Only a count and five examples reach the driver."""
    if on_error not in ("fail", "quarantine"):
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    if on_error == "fail":
        bad = quarantine(validated)
        n_bad = bad.count()
        if n_bad:
            examples = [(r["pos"], r["first_error"]) for r in
                        bad.orderBy("batch_id", "pos").select("pos", "first_error").take(5)]
            raise ValidationFailed(n_bad, examples)
    return accepted(validated)
