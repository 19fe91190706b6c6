"""The flagship computation: impressions with padded, point-in-time-correct histories."""

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    COL_ACTION_TYPE,
    COL_ACTION_TYPES,
    COL_ACTIONS,
    COL_BAD_IMPRESSIONS,
    COL_CUSTOMER_ID,
    COL_DT,
    COL_IMPRESSION_ITEM_ID,
    COL_IMPRESSIONS,
    COL_ITEM_ID,
    COL_RANKING_ID,
    DEFAULT_LOOKBACK_DAYS,
    DEFAULT_MAX_SEQ,
)
from ..functions import pad_right
from ..operators import (
    attach_by_customer_day,
    explode_impressions,
    impression_keys,
    keyed_history,
    normalize_actions,
    prune_logs,
    window_activity,
)
from ..operators.history import check_window
from ..operators.impressions import check_impressions

MAP_SIDE_RANK_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _flags(impressions_df: DataFrame) -> list[str]:
    return [COL_BAD_IMPRESSIONS] if COL_BAD_IMPRESSIONS in impressions_df.columns else []


def _ranking_columns(impressions_df: DataFrame) -> DataFrame:
    return impressions_df.select(
        COL_DT, COL_RANKING_ID, COL_CUSTOMER_ID, COL_IMPRESSIONS, *_flags(impressions_df)
    )


def padded_inputs(impressions_df: DataFrame, history: DataFrame, max_seq: int, item_type: str) -> DataFrame:
    """Training inputs of the impressions from ragged histories by customer and day."""
    rankings = attach_by_customer_day(_ranking_columns(impressions_df), history)
    return _padded(rankings, max_seq, item_type)


def _padded(rankings: DataFrame, max_seq: int, item_type: str) -> DataFrame:
    # Padded once per ranking, after the last shuffle, and then repeated for each of its items.
    flags = _flags(rankings)
    padded = rankings.select(
        COL_DT,
        COL_RANKING_ID,
        COL_CUSTOMER_ID,
        COL_IMPRESSIONS,
        pad_right(F.col("items"), max_seq, item_type).alias(COL_ACTIONS),
        pad_right(F.col("types"), max_seq, "tinyint").alias(COL_ACTION_TYPES),
        *flags,
    )
    return explode_impressions(padded, carry=[COL_ACTIONS, COL_ACTION_TYPES, *flags])


def _rankings_with_history(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    lookback_days: int,
    max_seq: int,
    order: str,
) -> tuple[DataFrame, str]:
    """Unexploded rankings with ragged ``items`` / ``types``, and the type of the items."""
    check_impressions(impressions_df)
    spark = impressions_df.sparkSession
    if max_seq > int(spark.conf.get(MAP_SIDE_RANK_LIMIT)):
        warnings.warn(
            f"max_seq={max_seq} is above {MAP_SIDE_RANK_LIMIT}; raise it to max_seq, or hot "
            "customers are shuffled whole before they are cut",
            stacklevel=3,
        )
    keys = impression_keys(impressions_df)
    actions = normalize_actions(
        *prune_logs(impressions_df, clicks_df, atc_df, orders_df, lookback_days=lookback_days)
    )
    history = keyed_history(keys, actions, lookback_days=lookback_days, max_seq=max_seq, order=order)
    item_type = actions.schema[COL_ITEM_ID].dataType.simpleString()
    return attach_by_customer_day(_ranking_columns(impressions_df), history), item_type


def build_training_inputs(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    *,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    max_seq: int = DEFAULT_MAX_SEQ,
    order: str = "recent_first",
) -> DataFrame:
    """One row per impression: ``dt, ranking_id, customer_id, impression_item_id, is_order``, and
    ``actions`` / ``action_types``, two parallel arrays of exactly ``max_seq`` entries.

    The arrays hold the customer's newest actions in ``[dt - lookback_days, dt)``, newest first
    (or oldest first with ``order="oldest_first"``), filled up with zeros on the right. An
    impression without history, without customer or with a malformed ``dt`` is all padding. Item
    id 0 is reserved for padding. A column ``bad_impressions`` (see ``coerce_impressions_from_json``) is carried along.

    Lazy: no job runs here. Each log is read once, and only the days that the impressions can look
    back to (``prune_logs``).
    """
    lookback_days, max_seq = check_window(lookback_days, max_seq)
    rankings, item_type = _rankings_with_history(
        impressions_df, clicks_df, atc_df, orders_df, lookback_days, max_seq, order
    )
    return _padded(rankings, max_seq, item_type)


def history_entries(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    *,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    max_seq: int = DEFAULT_MAX_SEQ,
) -> DataFrame:
    """The same histories in long form: one row per impression and entry.

    ``rn`` is the recency rank, 1 for the newest. Impressions without history have no rows.
    """
    lookback_days, max_seq = check_window(lookback_days, max_seq)
    rankings, _ = _rankings_with_history(
        impressions_df, clicks_df, atc_df, orders_df, lookback_days, max_seq, "recent_first"
    )
    entries = F.arrays_zip(F.col("items").alias(COL_ITEM_ID), F.col("types").alias(COL_ACTION_TYPE))
    with_entries = rankings.where(F.col("items").isNotNull()).withColumn("entries", entries)
    return explode_impressions(with_entries, carry=["entries"]).select(
        COL_DT,
        COL_RANKING_ID,
        COL_CUSTOMER_ID,
        COL_IMPRESSION_ITEM_ID,
        F.posexplode("entries").alias("pos", "entry"),
    ).select(
        COL_DT,
        COL_RANKING_ID,
        COL_CUSTOMER_ID,
        COL_IMPRESSION_ITEM_ID,
        (F.col("pos") + 1).alias("rn"),
        F.col(f"entry.{COL_ITEM_ID}").alias(COL_ITEM_ID),
        F.col(f"entry.{COL_ACTION_TYPE}").alias(COL_ACTION_TYPE),
    )


def impression_activity(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    *,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
) -> DataFrame:
    """One row per impression with the activity in its whole window, not cut at any length."""
    check_impressions(impressions_df)
    lookback_days, _ = check_window(lookback_days)
    keys = impression_keys(impressions_df)
    actions = normalize_actions(
        *prune_logs(impressions_df, clicks_df, atc_df, orders_df, lookback_days=lookback_days)
    )
    activity = window_activity(keys, actions, lookback_days=lookback_days)
    counts = [c for c in activity.columns if c.startswith("n_")]
    rankings = attach_by_customer_day(_ranking_columns(impressions_df), activity).fillna(0, counts)
    return explode_impressions(rankings, carry=[*counts, "first_ts", "last_ts"])
