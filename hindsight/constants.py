"""Fixed values of the data contract: action codes, defaults, column names."""

# Action codes stored in ``action_type`` / ``action_types``.
ACTION_PADDING = 0
ACTION_CLICK = 1
ACTION_ADD_TO_CART = 2
ACTION_PREVIOUS_ORDER = 3

# One year of history, a thousand positions.
DEFAULT_LOOKBACK_DAYS = 365
DEFAULT_MAX_SEQ = 1000

# Column names.
COL_DT = "dt"
COL_RANKING_ID = "ranking_id"
COL_CUSTOMER_ID = "customer_id"
COL_IMPRESSIONS = "impressions"
COL_ITEM_ID = "item_id"
COL_IS_ORDER = "is_order"
COL_TS = "ts"
COL_ACTION_TYPE = "action_type"
COL_IMPRESSION_ITEM_ID = "impression_item_id"
COL_ACTIONS = "actions"
COL_ACTION_TYPES = "action_types"
# Optional: whether a ranking's impressions arrived as text that could not be parsed.
COL_BAD_IMPRESSIONS = "bad_impressions"
