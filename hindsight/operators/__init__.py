from .actions import normalize_actions
from .attach import attach_by_customer_day
from .history import cap_daily, keyed_history
from .impressions import explode_impressions, impression_keys
from .pruning import prune_logs
from .window_activity import window_activity

__all__ = [
    "attach_by_customer_day",
    "cap_daily",
    "explode_impressions",
    "impression_keys",
    "keyed_history",
    "normalize_actions",
    "prune_logs",
    "window_activity",
]
