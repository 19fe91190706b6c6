"""Analytics on training inputs: sequence lengths and action types by position."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COL_ACTION_TYPES, COL_ACTIONS
from ..functions import nonzero_count, require_columns, whole_number
from ..streaming import require_batch


def sequence_lengths(df: DataFrame) -> DataFrame:
    """``(history_length, n)``: number of rows for each count of non-zero actions."""
    require_batch(df, "training inputs")
    require_columns(df, [COL_ACTIONS], "training inputs")
    return df.groupBy(nonzero_count(F.col(COL_ACTIONS)).alias("history_length")).agg(
        F.count("*").alias("n")
    )


def sequence_length_distribution(df: DataFrame) -> dict[int, int]:
    """``sequence_lengths`` as a dict from length to number of rows."""
    return {row["history_length"]: row["n"] for row in sequence_lengths(df).collect()}


def action_types_by_position(df: DataFrame, max_positions: int = 10) -> DataFrame:
    """``(pos, action_type, n, share)`` for the first ``max_positions`` positions, from 0.

    ``share`` is relative to all rows that reach the position; padding is a type like any other.
    """
    require_batch(df, "training inputs")
    require_columns(df, [COL_ACTION_TYPES], "training inputs")
    max_positions = whole_number("max_positions", max_positions, 1)
    counts = (
        df.select(F.posexplode(F.slice(COL_ACTION_TYPES, 1, max_positions)).alias("pos", "action_type"))
        .groupBy("pos", "action_type")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("pos"))
    return counts.withColumn("share", F.col("n") / total)


def action_type_frequency_by_position(df: DataFrame, max_positions: int = 10) -> list[dict[str, float]]:
    """``action_types_by_position`` as a list, one dict from code to share per position.

    As long as the longest array, ``max_positions`` at most; empty for an empty frame.
    """
    frequencies: list[dict[str, float]] = []
    rows = action_types_by_position(df, max_positions).orderBy("pos", "action_type").collect()
    for row in rows:
        if row["pos"] == len(frequencies):
            frequencies.append({})
        frequencies[row["pos"]][str(row["action_type"])] = row["share"]
    return frequencies
