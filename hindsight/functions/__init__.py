from .checks import require_columns, require_same_kind, require_types, whole_number
from .days import epoch_day, midnight, text_day
from .sequences import nonzero_count, pad_right

__all__ = [
    "epoch_day",
    "midnight",
    "nonzero_count",
    "pad_right",
    "require_columns",
    "require_same_kind",
    "require_types",
    "text_day",
    "whole_number",
]
