"""Cut the action logs down to the days that some impression can look back to."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import midnight
from .actions import check_logs
from .history import check_window
from .impressions import check_impressions, impression_keys


def prune_logs(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    *,
    lookback_days: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three logs without rows outside ``[first day - lookback, last day)`` of the impressions.

    Lazy: the bounds are scalar subqueries over the impressions' days, compared with each log's own
    time column in its own type, so they are known before the logs are scanned and are pushed into
    the scans, where they skip files and row groups. Without any impression that has a customer
    and a day nothing is left.
    """
    check_impressions(impressions_df)
    lookback_days, _ = check_window(lookback_days)
    logs = check_logs(clicks_df, atc_df, orders_df)
    days = impression_keys(impressions_df, distinct=False)

    def prune(log: DataFrame, when: str) -> DataFrame:
        time_type = log.schema[when].dataType.simpleString()
        # Bounds as ready values of the column's type: only then are they pushed into the scan.
        first = days.select(midnight(F.min("day") - lookback_days, time_type).alias("first")).scalar()
        last = days.select(midnight(F.max("day"), time_type).alias("last")).scalar()
        return log.where((F.col(when) >= first) & (F.col(when) < last))

    return tuple(prune(log, when) for log, when in logs)
