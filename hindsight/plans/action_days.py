"""Stored state for daily runs: the capped actions of each day, kept as one partition per day.

``cap_daily`` looks at one day of a customer at a time, so a day that is capped and stored once serves every later
run: tomorrow's run adds one day and reads the stored ones, instead of a year of raw logs. A day is written as
a whole and replaces what was stored for it, so reruns and late data need no more than writing that day again.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COL_ACTION_TYPE, COL_CUSTOMER_ID, COL_ITEM_ID, COL_TS, DEFAULT_LOOKBACK_DAYS, DEFAULT_MAX_SEQ
from ..functions import epoch_day
from ..operators import cap_daily, impression_keys, normalize_actions
from ..operators.actions import check_logs
from ..operators.history import capped_history, check_window, reachable_actions, usable_actions
from ..operators.impressions import check_impressions
from ..sources.writers import replace_partitions
from .training_inputs import padded_inputs

COL_DAY = "action_day"


def _location(path: str, max_seq: int) -> str:
    """States of different caps lie side by side: a longer one is not to be taken for a shorter one."""
    return f"{path.rstrip('/')}/max_seq={max_seq}"


def save_action_days(
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    path: str,
    first: date,
    last: date,
    *,
    max_seq: int = DEFAULT_MAX_SEQ,
) -> None:
    """Cap the actions of the days ``first`` to ``last``, both included, and store them under ``path``.

    The logs are read for these days only. Days that are stored already are replaced, other days stay; a
    day without actions replaces what was there with none.
    """
    _, max_seq = check_window(0, max_seq)
    if not (type(first) is type(last) is date and first <= last):
        raise ValueError(f"first and last must be dates in order, got {first!r} and {last!r}")
    logs = [
        log.where((F.col(when) >= F.lit(first)) & (F.col(when) < F.date_add(F.lit(last), 1)))
        for log, when in check_logs(clicks_df, atc_df, orders_df)
    ]
    capped = cap_daily(usable_actions(normalize_actions(*logs)), max_seq)
    days = capped.withColumn(COL_DAY, F.date_from_unix_date("day")).drop("day")
    # A row without a customer for every day, so that each one's partition is written.
    spark = clicks_df.sparkSession
    marks = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(COL_DAY))
    rows = days.unionByName(marks, allowMissingColumns=True)
    replace_partitions(rows.repartition(COL_DAY, F.pmod(F.hash(COL_CUSTOMER_ID), F.lit(_files(spark)))), _location(path, max_seq), [COL_DAY])


def _files(spark: SparkSession) -> int:
    """Files of a day, which is also how many tasks a day's rows are written by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) // 32 + 1


def load_action_days(spark: SparkSession, path: str, *, max_seq: int = DEFAULT_MAX_SEQ) -> DataFrame:
    """The stored actions: ``customer_id, item_id, ts, action_type, back, action_day``."""
    return spark.read.parquet(_location(path, max_seq)).where(F.col(COL_CUSTOMER_ID).isNotNull())


def build_training_inputs_from_days(
    impressions_df: DataFrame,
    action_days: DataFrame,
    *,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    max_seq: int = DEFAULT_MAX_SEQ,
    order: str = "recent_first",
) -> DataFrame:
    """``build_training_inputs`` from stored days, which ``load_action_days`` has read for the same ``max_seq``.

    Only the partitions that the impressions can look back to are read. Days that were never stored count as
    days without actions.
    """
    check_impressions(impressions_df)
    lookback_days, max_seq = check_window(lookback_days, max_seq)
    keys = impression_keys(impressions_df)
    span = impression_keys(impressions_df, distinct=False)
    first = span.select(F.date_from_unix_date(F.min("day") - lookback_days).alias("first")).scalar()
    last = span.select(F.date_from_unix_date(F.max("day")).alias("last")).scalar()
    actions = action_days.where((F.col(COL_DAY) >= first) & (F.col(COL_DAY) < last)).select(
        COL_CUSTOMER_ID, COL_ITEM_ID, COL_TS, COL_ACTION_TYPE, "back", epoch_day(F.col(COL_DAY)).alias("day")
    )
    capped = reachable_actions(actions, keys, lookback_days)
    history = capped_history(keys, capped, lookback_days=lookback_days, max_seq=max_seq, order=order)
    return padded_inputs(impressions_df, history, max_seq, actions.schema[COL_ITEM_ID].dataType.simpleString())
