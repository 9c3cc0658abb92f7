"""Wire-format checks as column expressions (one error code per field).

Each ``*_error`` returns the code of the first failing check of that field, or
NULL when the field is valid; ``canonical_*`` return the normalised value.
Codes follow the validator vocabulary the wire contract is specified in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.schema import (
    AMOUNT_MAX_DIGITS,
    AMOUNT_SCALE,
    EVENT_TYPES,
    MERCHANT_ID_MAX_LEN,
    MERCHANT_NAME_MAX_LEN,
    MONEY,
)

# Fixed patterns of the wire format.
# A UUID is written with hyphens (alone, in braces or as a URN) or as 32 digits.
_HYPHENATED = r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
UUID_PATTERN = rf"^((urn:uuid:)?{_HYPHENATED}|\{{{_HYPHENATED}\}}|(?i:[0-9a-f]{{32}}))$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LETTERS_PATTERN = r"^\p{L}+$"
# A date, or a date and a time, with an optional offset. Times without a date
# would silently become today's; epoch numbers are not taken as times.
TIMESTAMP_PATTERN = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
                     r"([Tt _][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$")

MESSAGES = {
    "missing": "Field required",
    "uuid_parsing": "Input should be a valid UUID",
    "enum": "Input should be one of: " + ", ".join(EVENT_TYPES),
    "string_too_short": "String should have at least the minimum number of characters",
    "string_too_long": "String should have at most the maximum number of characters",
    "string_type": "Input should be a valid string",
    "decimal_type": "Decimal input should be an integer, float or string",
    "decimal_parsing": "Input should be a valid decimal",
    "greater_than_equal": "Input should be greater than or equal to 0",
    "decimal_max_digits": f"Decimal input should have no more than {AMOUNT_MAX_DIGITS} digits in total",
    "decimal_max_places": f"Decimal input should have no more than {AMOUNT_SCALE} decimal places",
    "decimal_whole_digits": (f"Decimal input should have no more than {AMOUNT_MAX_DIGITS - AMOUNT_SCALE} "
                             "digits before the decimal point"),
    "currency_code": "currency must be a 3-letter ISO 4217 code",
    "datetime_parsing": "Input should be a valid datetime",
    "extra_forbidden": "Extra inputs are not permitted",
}


def _missing(c: Column) -> Column:
    return c.isNull()


def uuid_error(c: Column) -> Column:
    return F.when(_missing(c), F.lit("missing")).when(~c.rlike(UUID_PATTERN), F.lit("uuid_parsing"))


def hyphenated_uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of a UUID text already known to be valid."""
    # Braces go with the hyphens; a URN's prefix stands before the last 32 digits.
    hexed = F.substring(F.lower(F.translate(c, "-{}", "")), -32, 32)
    return F.concat_ws("-", *[F.substring(hexed, start, length)
                              for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canonical_uuid(c: Column) -> Column:
    """Lower-case, hyphenated form of a valid UUID text; NULL otherwise."""
    return F.when(c.rlike(UUID_PATTERN), hyphenated_uuid(c))


def event_type_error(c: Column) -> Column:
    return F.when(_missing(c), F.lit("missing")).when(~c.isin(*EVENT_TYPES), F.lit("enum"))


def length_error(c: Column, lo: int, hi: int) -> Column:
    n = F.length(c)
    return (F.when(_missing(c), F.lit("missing"))
             .when(n < lo, F.lit("string_too_short"))
             .when(n > hi, F.lit("string_too_long")))


def merchant_id_error(c: Column) -> Column:
    return length_error(c, 1, MERCHANT_ID_MAX_LEN)


def merchant_name_error(c: Column) -> Column:
    return length_error(c, 1, MERCHANT_NAME_MAX_LEN)


def _digit_counts(c: Column) -> tuple[Column, Column]:
    """(whole digits, decimal places) of a decimal text, ignoring redundant zeros.

    Plain string functions (no regex) on text that already matched
    ``DECIMAL_PATTERN``. An exponent moves the point.
    """
    signed = c.startswith("+") | c.startswith("-")
    unsigned = F.translate(F.when(signed, F.substring(c, 2, 1 << 30)).otherwise(c), "E", "e")
    plain = F.substring_index(unsigned, "e", 1)
    frac = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(F.lit(""))
    significant = F.ltrim(F.concat(F.substring_index(plain, ".", 1), frac), F.lit("0"))
    digits = F.length(F.rtrim(significant, F.lit("0")))
    # An exponent past an int leaves no amount but zero in range, whatever its sign.
    exponent = F.when(unsigned.contains("e"), F.coalesce(F.substring_index(unsigned, "e", -1).try_cast("int").cast("long"), F.lit(1 << 31))) \
        .otherwise(F.lit(0).cast("long"))
    last = exponent - F.length(frac) + F.length(significant) - digits     # the power of ten of the last digit
    none = digits == 0
    whole = F.when(none, F.lit(0)).otherwise(F.greatest(digits + last, F.lit(0)))
    return whole, F.when(none, F.lit(0)).otherwise(F.greatest(-last, F.lit(0)))


def exact_amount(c: Column) -> Column:
    """The value of a valid amount text; a zero may have any exponent."""
    return F.coalesce(c.try_cast("decimal(38,10)"), F.when(c.isNotNull(), F.lit(0).cast("decimal(38,10)"))).cast(MONEY)


def amount_error(c: Column) -> Column:
    """Exact decimal >= 0 with at most 14 digits, 2 of them after the point.

    Checked on the text: a numeric cast first would silently round 1.239.
    """
    whole, places = _digit_counts(c)
    # With redundant zeros stripped, any remaining digit means a non-zero value.
    negative = c.startswith("-") & (whole + places > 0)
    return (F.when(_missing(c), F.lit("missing"))
             .when(~c.rlike(DECIMAL_PATTERN), F.lit("decimal_parsing"))
             .when(whole + places > AMOUNT_MAX_DIGITS, F.lit("decimal_max_digits"))
             .when(places > AMOUNT_SCALE, F.lit("decimal_max_places"))
             .when(whole > AMOUNT_MAX_DIGITS - AMOUNT_SCALE, F.lit("decimal_whole_digits"))
             .when(negative, F.lit("greater_than_equal")))


def canonical_amount(c: Column) -> Column:
    """Exact decimal(14,2) of a valid amount text (never via a float)."""
    return F.when(amount_error(c).isNull(), exact_amount(c))


def currency_error(c: Column) -> Column:
    n = F.length(c)
    return (F.when(_missing(c), F.lit("missing"))
             .when(n < 3, F.lit("string_too_short"))
             .when(n > 3, F.lit("string_too_long"))
             .when(~F.upper(c).rlike(LETTERS_PATTERN), F.lit("currency_code")))


def canonical_currency(c: Column) -> Column:
    return F.when(currency_error(c).isNull(), F.upper(c))


def parsed_timestamp(c: Column) -> Column:
    """UTC wall-clock instant: naive text is UTC, offsets are converted."""
    return F.when(c.rlike(TIMESTAMP_PATTERN), F.try_to_timestamp(F.translate(c, "t_z", "T Z"))).cast("timestamp_ntz")


def timestamp_error(c: Column, parsed: Column | None = None) -> Column:
    parsed = parsed_timestamp(c) if parsed is None else parsed
    return F.when(_missing(c), F.lit("missing")).when(parsed.isNull(), F.lit("datetime_parsing"))
