"""Metrics as partial sums by day, which merge to those of any set of days.

The table has one row per day, kind, position and value: how many training inputs have a history of that
length (``length``), how many positions an action type (``type``), how many inputs an action type at a position
(``position``). All are counts, so those of days add up, a day that is run again replaces its own, and
distributions of a year come from a few rows a day instead of a year of training inputs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COL_ACTION_TYPES, COL_ACTIONS, COL_DT
from ..functions import nonzero_count, require_columns, text_day, whole_number
from ..streaming import require_batch
from .quality import code_counts

LENGTH, TYPE, POSITION = "length", "type", "position"


def metrics_by_day(df: DataFrame, max_positions: int = 10) -> DataFrame:
    """``dt, kind, pos, value, n`` of training inputs in one pass; ``pos`` is null but for positions."""
    require_batch(df, "training inputs")
    require_columns(df, [COL_DT, COL_ACTIONS, COL_ACTION_TYPES], "training inputs")
    max_positions = whole_number("max_positions", max_positions, 1)
    none = F.lit(None).cast("int")

    def line(kind, pos, value, n):
        return F.struct(
            F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), value.cast("int").alias("value"), n.cast("long").alias("n")
        )

    types = F.col(COL_ACTION_TYPES)
    counts, rest = code_counts(types)
    one = F.lit(1)
    lines = F.concat(
        F.array(
            line(LENGTH, none, nonzero_count(F.col(COL_ACTIONS)), one),
            *[line(TYPE, none, F.lit(code), F.coalesce(n, F.lit(0))) for code, n in counts.items()],
        ),
        # Other codes, normally none.
        F.coalesce(F.transform(rest, lambda code: line(TYPE, none, code, one)), F.array()),
        F.coalesce(F.transform(F.slice(types, 1, max_positions), lambda code, pos: line(POSITION, pos, code, one)), F.array()),
    )
    rows = df.select(COL_DT, F.inline(lines)).where("n > 0")
    return rows.groupBy(COL_DT, "kind", "pos", "value").agg(F.sum("n").alias("n"))


def _total(metrics: DataFrame, kind: str, *keys: str) -> DataFrame:
    return metrics.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("n").alias("n"))


def merged_sequence_lengths(metrics: DataFrame) -> DataFrame:
    """``sequence_lengths`` of all the days in ``metrics``."""
    return _total(metrics, LENGTH, "value").select(F.col("value").alias("history_length"), "n")


def merged_action_types(metrics: DataFrame) -> DataFrame:
    """``action_type_distribution`` of all the days in ``metrics``."""
    counts = _total(metrics, TYPE, "value")
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(F.col("value").cast("tinyint").alias("action_type"), "n", (F.col("n") / total).alias("share"))


def merged_types_by_position(metrics: DataFrame) -> DataFrame:
    """``action_types_by_position`` of all the days in ``metrics``."""
    counts = _total(metrics, POSITION, "pos", "value")
    total = F.sum("n").over(Window.partitionBy("pos"))
    return counts.select("pos", F.col("value").cast("tinyint").alias("action_type"), "n", (F.col("n") / total).alias("share"))


def merged_summary(metrics: DataFrame) -> DataFrame:
    """``dq_summary`` of all the days in ``metrics``."""
    lengths = metrics.where(F.col("kind") == LENGTH).select(text_day(metrics, COL_DT).alias("day"), "value", "n")
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    rows = F.sum("n")
    return lengths.agg(
        F.coalesce(rows, F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.lit(0)).alias("bad_dt_rows"),
        F.try_divide(F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)), rows).alias("zero_history_pct"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), known).alias("avg_history_length"),
    )
