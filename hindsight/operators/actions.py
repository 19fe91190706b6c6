"""Clicks, add-to-carts and orders as one action log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    ACTION_ADD_TO_CART,
    ACTION_CLICK,
    ACTION_PREVIOUS_ORDER,
    COL_ACTION_TYPE,
    COL_CUSTOMER_ID,
    COL_ITEM_ID,
    COL_TS,
)
from ..functions import require_columns, require_same_kind, require_types
from ..functions.checks import INSTANT
from ..streaming import require_batch


def check_logs(
    clicks_df: DataFrame, atc_df: DataFrame, orders_df: DataFrame
) -> list[tuple[DataFrame, str]]:
    """Check the three logs and name their time columns."""
    for df, name, item, when in (
        (clicks_df, "clicks_df", "item_id", "click_time"),
        (atc_df, "atc_df", "config_id", "occurred_at"),
        (orders_df, "orders_df", "config_id", "order_date"),
    ):
        require_batch(df, name)
        require_columns(df, [COL_CUSTOMER_ID, item, when], name)
        require_types(df, {when: INSTANT}, name)
    require_same_kind(COL_CUSTOMER_ID, {"clicks_df": clicks_df, "atc_df": atc_df, "orders_df": orders_df})
    return [(clicks_df, "click_time"), (atc_df, "occurred_at"), (orders_df, "order_date")]


def _timestamp_type(*times: T.DataType) -> str:
    """One time line for all logs: zone-less as soon as one of them is."""
    return "timestamp_ntz" if any(isinstance(t, T.TimestampNTZType) for t in times) else "timestamp"


def _action(item: str, ts: Column, code: int) -> list[Column]:
    return [
        F.col(COL_CUSTOMER_ID),
        F.col(item).alias(COL_ITEM_ID),
        ts.alias(COL_TS),
        F.lit(code).cast("tinyint").alias(COL_ACTION_TYPE),
    ]


def normalize_actions(clicks_df: DataFrame, atc_df: DataFrame, orders_df: DataFrame) -> DataFrame:
    """``(customer_id, item_id, ts, action_type)`` over the three logs, duplicates kept.

    An order has a date only and counts as done at its midnight.
    """
    logs = check_logs(clicks_df, atc_df, orders_df)
    ts_type = _timestamp_type(*[log.schema[when].dataType for log, when in logs])
    clicks = clicks_df.select(_action("item_id", F.col("click_time").cast(ts_type), ACTION_CLICK))
    carts = atc_df.select(_action("config_id", F.col("occurred_at").cast(ts_type), ACTION_ADD_TO_CART))
    order_midnight = F.col("order_date").cast("date").cast(ts_type)
    orders = orders_df.select(_action("config_id", order_midnight, ACTION_PREVIOUS_ORDER))
    return clicks.unionByName(carts).unionByName(orders)
