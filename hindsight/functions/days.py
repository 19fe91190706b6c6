"""Calendar days.

Both window bounds are midnights of a calendar day, so the whole engine compares day numbers
(days since 1970-01-01, in the session time zone) and looks at the time only to order actions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_day(column: Column) -> Column:
    """Day number of a date or timestamp."""
    return F.unix_date(column.cast("date"))


def text_day(df: DataFrame, name: str) -> Column:
    """Day number of column ``name``: a date, or a string of the form ``YYYY-MM-DD``.

    Casts take more for a day (a year, a time of day, spaces around); such strings give null here, as do
    days that the calendar does not have.
    """
    column = df[name]
    if isinstance(df.schema[name].dataType, T.StringType):
        column = F.when(column.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), column).try_cast("date")
    return F.unix_date(column)


def midnight(day: Column, ts_type: str) -> Column:
    """First instant of a day number, as ``timestamp`` or ``timestamp_ntz``."""
    return F.date_from_unix_date(day).cast(ts_type)
