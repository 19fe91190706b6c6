"""As-of range join in aggregated form: what happened in the window of each key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..constants import (
    ACTION_ADD_TO_CART,
    ACTION_CLICK,
    ACTION_PREVIOUS_ORDER,
    COL_ACTION_TYPE,
    COL_CUSTOMER_ID,
    COL_TS,
)
from ..functions import require_same_kind
from .history import check_window, reachable_actions, usable_actions

_COUNTS = {
    "n_clicks": ACTION_CLICK,
    "n_add_to_carts": ACTION_ADD_TO_CART,
    "n_orders": ACTION_PREVIOUS_ORDER,
}


def window_activity(keys: DataFrame, actions: DataFrame, *, lookback_days: int) -> DataFrame:
    """Per key: number of actions in ``[day - lookback, day)``, by type, and first and last ``ts``.

    Actions that no key of their customer reaches go first. The others are summed up per customer and day before any customer's rows meet in one task. Frames
    that only ever grow then take the place of the join: what is counted before the window's end
    less what is counted before its start. Each key keeps its row.
    """
    lookback_days, _ = check_window(lookback_days)
    require_same_kind(COL_CUSTOMER_ID, {"impressions": keys, "actions": actions})
    daily = (
        reachable_actions(usable_actions(actions), keys, lookback_days)
        .groupBy(COL_CUSTOMER_ID, "day")
        .agg(
            F.count("*").alias("n_actions"),
            *[F.count_if(F.col(COL_ACTION_TYPE) == code).alias(name) for name, code in _COUNTS.items()],
            F.min(COL_TS).alias("first_ts"),
            F.max(COL_TS).alias("last_ts"),
        )
    )
    by_customer = Window.partitionBy(COL_CUSTOMER_ID)
    before_end = by_customer.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    before_start = by_customer.orderBy("day").rangeBetween(Window.unboundedPreceding, -(lookback_days + 1))
    # In descending order "preceding" are the later days, and the frame ends with the first one.
    since_start = by_customer.orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, lookback_days)

    def total(name: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    names = ("n_actions", *_COUNTS)
    any_action = F.col("n_actions") > 0
    return (
        keys.withColumn("is_key", F.lit(True))
        .unionByName(daily.withColumn("is_key", F.lit(False)), allowMissingColumns=True)
        .select(
            COL_CUSTOMER_ID,
            "day",
            "is_key",
            *[(total(name, before_end) - total(name, before_start)).alias(name) for name in names],
            F.min("first_ts").over(since_start).alias("first_ts"),
            F.max("last_ts").over(before_end).alias("last_ts"),
        )
        .where("is_key")
        .select(
            COL_CUSTOMER_ID,
            "day",
            *names,
            F.when(any_action, F.col("first_ts")).alias("first_ts"),
            F.when(any_action, F.col("last_ts")).alias("last_ts"),
        )
    )
