"""Column -> Column helpers. All are built-in Spark expressions, so they stay inside
whole-stage codegen; none is a Python UDF."""

from funnelkit.functions.columns import (
    default_zero, flag, is_missing, not_in_list, key_type, match_key, salted_key,
)
from funnelkit.functions.dates import (
    date_gate, lookback_start, month_boundaries, months_fractional,
)
from funnelkit.functions.slots import (
    null_safe_sum, slot_coalesce, slot_count_leading, slot_max, slot_min, slot_min_sentinel,
)

__all__ = [
    "default_zero", "flag", "is_missing", "not_in_list", "key_type", "match_key", "salted_key",
    "date_gate", "lookback_start", "month_boundaries", "months_fractional",
    "null_safe_sum", "slot_coalesce", "slot_count_leading", "slot_max", "slot_min",
    "slot_min_sentinel",
]
