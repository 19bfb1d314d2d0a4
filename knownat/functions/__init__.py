"""Column expressions shared by the operators; all of them stay inside whole-stage codegen."""

from knownat.functions.dates import (
    calendar_quarter_label,
    fiscal_position,
    lenient_date,
    quarter_end,
    quarter_position,
    quarter_start,
)
from knownat.functions.ids import composite_key, hash_score, pad_id, split_key
from knownat.functions.numbers import (
    clamp,
    clean_number,
    finite,
    flag,
    guarded_ratio,
    logit,
    null_aware_sum,
    round_half_away,
    sigmoid,
)

__all__ = [
    "calendar_quarter_label",
    "clamp",
    "clean_number",
    "composite_key",
    "finite",
    "fiscal_position",
    "flag",
    "guarded_ratio",
    "hash_score",
    "lenient_date",
    "logit",
    "null_aware_sum",
    "pad_id",
    "quarter_end",
    "quarter_position",
    "quarter_start",
    "round_half_away",
    "sigmoid",
    "split_key",
]
