"""Nested impressions that arrive as text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..constants import COL_IMPRESSIONS
from ..schema import impression_struct


def coerce_impressions_from_json(df: DataFrame, col: str = COL_IMPRESSIONS, flag: str | None = None) -> DataFrame:
    """Parse a JSON string column to ``array<struct<item_id, is_order>>``.

    A missing column, or one that is not a string, leaves the frame as it is. Text that is not
    JSON gives null. With ``flag``, a boolean column of that name tells which rows had text that is not such an
    array: not JSON, of another shape, or with fields of another type (these fields are null, the others kept).
    """
    if col not in df.columns or not isinstance(df.schema[col].dataType, StringType):
        return df
    parsed = F.from_json(F.col(col), ArrayType(impression_struct))
    if flag is None:
        return df.withColumn(col, parsed)
    return df.withColumns({col: parsed, flag: _is_bad(F.col(col))})


def _is_bad(text: Column) -> Column:
    """Whether text is there and not the JSON of impressions.

    The parser hands rejected text to a column of its own only for objects, so the array becomes a field of one.
    """
    reject = "_reject"
    wrapped = StructType([StructField("slots", ArrayType(impression_struct)), StructField(reject, StringType())])
    told = F.from_json(F.concat(F.lit('{"slots":'), text, F.lit("}")), wrapped, {"columnNameOfCorruptRecord": reject})
    alone = F.from_json(text, ArrayType(impression_struct))
    return text.isNotNull() & (told[reject].isNotNull() | alone.isNull())


def bad_impressions(df: DataFrame, col: str = COL_IMPRESSIONS) -> DataFrame:
    """The rows of ``df`` whose text in ``col`` is not the JSON of impressions, as they came."""
    return df.where(_is_bad(F.col(col)))
