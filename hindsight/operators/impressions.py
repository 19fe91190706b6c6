"""Impressions: nested rankings to rows, and the keys their histories hang on."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    COL_CUSTOMER_ID,
    COL_DT,
    COL_IMPRESSION_ITEM_ID,
    COL_IMPRESSIONS,
    COL_IS_ORDER,
    COL_ITEM_ID,
    COL_RANKING_ID,
)
from ..functions import require_columns, require_types, text_day
from ..streaming import require_batch


def check_impressions(df: DataFrame) -> None:
    name = "impressions_df"
    require_batch(df, name)
    require_columns(df, [COL_DT, COL_RANKING_ID, COL_CUSTOMER_ID, COL_IMPRESSIONS], name)
    require_types(
        df,
        {COL_IMPRESSIONS: (T.ArrayType,), COL_DT: (T.StringType, T.DateType)},
        name,
    )


def explode_impressions(impressions_df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per element of ``impressions``, plus the ``carry`` columns of the ranking.

    A ranking whose array is null or empty keeps one row with a null item.
    """
    check_impressions(impressions_df)
    slot = F.col("_slot")
    return impressions_df.select(
        COL_DT, COL_RANKING_ID, COL_CUSTOMER_ID, F.explode_outer(COL_IMPRESSIONS).alias("_slot"), *carry
    ).select(
        COL_DT,
        COL_RANKING_ID,
        COL_CUSTOMER_ID,
        slot[COL_ITEM_ID].alias(COL_IMPRESSION_ITEM_ID),
        slot[COL_IS_ORDER].alias(COL_IS_ORDER),
        *carry,
    )


def impression_keys(impressions_df: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct ``(customer_id, day)``: all that a history depends on.

    Duplicates collapse map-side, so a customer with very many rankings costs one row per day and
    map task. Rows without a customer or with a malformed ``dt`` cannot have a history.
    """
    keys = impressions_df.select(COL_CUSTOMER_ID, text_day(impressions_df, COL_DT).alias("day")).where(
        F.col(COL_CUSTOMER_ID).isNotNull() & F.col("day").isNotNull()
    )
    return keys.distinct() if distinct else keys
