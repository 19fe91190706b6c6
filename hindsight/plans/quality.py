"""Data-quality metrics on training inputs."""

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    ACTION_ADD_TO_CART,
    ACTION_CLICK,
    ACTION_PADDING,
    ACTION_PREVIOUS_ORDER,
    COL_ACTION_TYPES,
    COL_ACTIONS,
    COL_BAD_IMPRESSIONS,
    COL_DT,
)
from ..functions import nonzero_count, require_columns, text_day
from ..streaming import require_batch

CODES = (ACTION_PADDING, ACTION_CLICK, ACTION_ADD_TO_CART, ACTION_PREVIOUS_ORDER)


def _check(df: DataFrame, *columns: str) -> None:
    require_batch(df, "training inputs")
    require_columns(df, columns, "training inputs")


def _bad_dt(df: DataFrame) -> Column:
    return text_day(df, COL_DT).isNull() if COL_DT in df.columns else F.lit(None).cast("boolean")


def dq_summary(df: DataFrame) -> DataFrame:
    """One row: ``total_rows``, ``bad_dt_rows``, ``zero_history_pct``, ``avg_history_length``.

    The history of a row is its non-zero actions. The last two are null on empty input. Where training
    inputs carry ``bad_impressions``, its rows are counted as ``bad_impressions_rows``.
    """
    _check(df, COL_ACTIONS)
    length = F.col("length")
    flags = [c for c in (COL_BAD_IMPRESSIONS,) if c in df.columns]
    return df.select(_bad_dt(df).alias("bad_dt"), nonzero_count(F.col(COL_ACTIONS)).alias("length"), *flags).agg(
        F.count("*").alias("total_rows"),
        F.count_if("bad_dt").alias("bad_dt_rows"),
        *[F.count_if(flag).alias(f"{flag}_rows") for flag in flags],
        F.avg(F.when(length == 0, 1.0).otherwise(0.0)).alias("zero_history_pct"),
        F.avg(length).alias("avg_history_length"),
    )


def _by_type(df: DataFrame, per_row: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: positions by action type, with row-level ``totals`` on the side.

    The codes of the contract are counted within the row, by what taking them out of the array
    shortens it; padding, the bulk, goes first. Only entries with other codes, normally none, are
    exploded and grouped, and row-level values are summed over the first line a row explodes to.
    At most one line per other code comes out, plus one.
    """
    rows = df.select(
        F.size(COL_ACTION_TYPES).alias("left"),
        F.col(COL_ACTION_TYPES).alias("rest"),
        *[column.alias(name) for name, column in per_row.items()],
    )
    for code in CODES:
        rows = rows.withColumn("rest", F.array_remove("rest", code)).withColumns(
            {f"n_{code}": F.col("left") - F.size("rest"), "left": F.size("rest")}
        )
    first = F.coalesce("pos", F.lit(0)) == 0
    sums = {**{f"n_{code}": F.col(f"n_{code}") for code in CODES}, **totals}
    return (
        rows.select("*", F.posexplode_outer("rest").alias("pos", "type"))
        .groupBy("type")
        .agg(
            F.count("pos").alias("n"),
            *[F.sum(F.when(first, column)).alias(name) for name, column in sums.items()],
        )
    )


def _counts() -> Column:
    """Array of ``(action_type, n)`` from all lines of ``_by_type``; bytes have 256 values at most."""
    known = [
        F.struct(F.lit(code).cast("tinyint").alias("action_type"), F.sum(f"n_{code}").alias("n"))
        for code in CODES
    ]
    others = F.collect_list(F.struct(F.col("type").alias("action_type"), "n"))
    return F.filter(F.concat(F.array(*known), others), lambda t: t["n"] > 0)


def _positions() -> Column:
    return F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, t: total + t["n"])


def action_type_distribution(df: DataFrame) -> DataFrame:
    """``(action_type, n, share)``: share of each code over all positions, padding included."""
    _check(df, COL_ACTION_TYPES)
    return (
        _by_type(df, {}, {})
        .agg(_counts().alias("counts"))
        .select(F.inline("counts"), _positions().alias("positions"))
        .select("action_type", "n", (F.col("n") / F.col("positions")).alias("share"))
    )


def dq_metrics(df: DataFrame) -> DataFrame:
    """``dq_summary`` and, as a map from code to share, the type distribution: one row, one pass."""
    _check(df, COL_ACTIONS, COL_ACTION_TYPES)
    length = F.col("length")
    totals = {
        "total_rows": F.lit(1),
        "bad_dt_rows": F.when(F.col("bad_dt"), 1).otherwise(0),
        "empty_rows": F.when(length == 0, 1).otherwise(0),
        "length_rows": F.when(length.isNotNull(), 1).otherwise(0),
        "length": length,
    }
    per_row = {"bad_dt": _bad_dt(df), "length": nonzero_count(F.col(COL_ACTIONS))}
    shares = F.transform(
        "counts",
        lambda t: F.struct(
            F.coalesce(t["action_type"].cast("string"), F.lit("None")), t["n"] / F.col("positions")
        ),
    )
    return (
        _by_type(df, per_row, totals)
        .agg(
            _counts().alias("counts"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in totals],
        )
        .withColumn("positions", _positions())
        .select(
            "total_rows",
            "bad_dt_rows",
            F.try_divide("empty_rows", "total_rows").alias("zero_history_pct"),
            F.try_divide("length", "length_rows").alias("avg_history_length"),
            F.map_from_entries(F.array_sort(shares)).alias("action_type_distribution"),
        )
    )


def code_counts(types: Column) -> tuple[dict[int, Column], Column]:
    """How often each code of the contract is in a row's array, and what is left of the array without them."""
    counts, rest = {}, types
    for code in CODES:
        without = F.array_remove(rest, code)
        counts[code] = F.size(rest) - F.size(without)
        rest = without
    return counts, rest


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """``df`` unchanged; the action that runs it leaves the sums behind ``dq_metrics`` in ``observation``.

    So a job has its metrics from the pass that writes, without reading anything again. Action types other
    than those of the contract are counted together.
    """
    _check(df, COL_ACTIONS, COL_ACTION_TYPES)
    length = nonzero_count(F.col(COL_ACTIONS))
    counts, rest = code_counts(F.col(COL_ACTION_TYPES))
    flags = [c for c in (COL_BAD_IMPRESSIONS,) if c in df.columns]
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(_bad_dt(df)).alias("bad_dt_rows"),
        F.count_if(length == 0).alias("empty_rows"),
        F.count(length).alias("length_rows"),
        F.sum(length.cast("long")).alias("length"),
        F.sum(F.size(rest).cast("long")).alias("n_other"),
        *[F.sum(n.cast("long")).alias(f"n_{code}") for code, n in counts.items()],
        *[F.count_if(flag).alias(f"{flag}_rows") for flag in flags],
    )


def observed_metrics(spark: SparkSession, observation: Observation) -> DataFrame:
    """The row of ``dq_metrics`` from what ``observed`` has left, and ``bad_impressions_rows`` if it was there."""
    sums = {name: value or 0 for name, value in observation.get.items()}
    shares = {code: sums[f"n_{code}"] for code in (*map(str, CODES), "other")}
    positions = sum(shares.values())
    flag = f"{COL_BAD_IMPRESSIONS}_rows"
    flags = [flag] if flag in sums else []
    row = (
        sums["total_rows"],
        sums["bad_dt_rows"],
        sums["empty_rows"] / sums["total_rows"] if sums["total_rows"] else None,
        sums["length"] / sums["length_rows"] if sums["length_rows"] else None,
        {code: n / positions for code, n in shares.items() if n},
        *[sums[name] for name in flags],
    )
    columns = "total_rows long, bad_dt_rows long, zero_history_pct double, avg_history_length double"
    added = "".join(f", {name} long" for name in flags)
    return spark.createDataFrame([row], f"{columns}, action_type_distribution map<string, double>{added}")


def calculate_dq_metrics(df: DataFrame) -> dict[str, Any]:
    """``zero_history_pct``, ``avg_history_length`` and ``action_type_distribution`` as a dict."""
    row = dq_metrics(df).first()
    return {
        "zero_history_pct": row["zero_history_pct"],
        "avg_history_length": row["avg_history_length"],
        "action_type_distribution": dict(row["action_type_distribution"]),
    }
