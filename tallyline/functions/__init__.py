"""Column builders. Everything here returns a ``Column``; nothing runs a job."""

from tallyline.functions.rules import (
    RULES,
    Horizon,
    age_hours,
    age_seconds,
    any_rule,
    discrepancy_array,
    discrepancy_detail,
    discrepancy_string,
    ts_literal,
)
from tallyline.functions.status import flat_status, payment_status, settlement_status, with_status

__all__ = [
    "RULES", "Horizon", "age_hours", "age_seconds", "any_rule", "discrepancy_array",
    "discrepancy_detail", "discrepancy_string", "ts_literal", "flat_status",
    "payment_status", "settlement_status", "with_status",
]
