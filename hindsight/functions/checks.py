"""Driver-side checks of schemas and parameters. None of them starts a job."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INSTANT = (T.TimestampType, T.TimestampNTZType, T.DateType)


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> None:
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")


def require_types(df: DataFrame, expected: dict[str, tuple[type, ...]], name: str) -> None:
    """``expected`` maps a column to the type classes it may have."""
    wrong = {
        column: df.schema[column].dataType.simpleString()
        for column, allowed in expected.items()
        if not isinstance(df.schema[column].dataType, allowed)
    }
    if wrong:
        raise ValueError(f"{name} has columns of unexpected type: {wrong}")


def require_same_kind(column: str, frames: dict[str, DataFrame]) -> None:
    """The column is a whole number in all frames, of whatever width, or of one type in all."""
    kinds = {
        name: "integral" if isinstance(df.schema[column].dataType, INTEGRAL) else df.schema[column].dataType.simpleString()
        for name, df in frames.items()
    }
    if len(set(kinds.values())) > 1:
        raise ValueError(f"{column} differs in type between frames: {kinds}")


def whole_number(name: str, value: int, least: int) -> int:
    """``value`` as an ``int``. Whole floats pass; booleans, fractions and anything else do not."""
    try:
        whole = None if isinstance(value, bool) else int(value)
    except (TypeError, ValueError, OverflowError):
        whole = None
    if whole is None or whole != value or whole < least:
        raise ValueError(f"{name} must be a whole number >= {least}, got {value!r}")
    return whole
