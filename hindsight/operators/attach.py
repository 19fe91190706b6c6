"""Bring results computed per customer and day back to the rows that asked for them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COL_CUSTOMER_ID, COL_DT
from ..functions import text_day


def attach_by_customer_day(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Left join ``rows`` (with ``customer_id``, ``dt``) to ``keyed`` (unique ``customer_id, day``).

    The big side is only ever on the left and the right side has one row per key, so adaptive
    execution may split a hot key's rows at will. Rows without a customer match nothing; they get
    a made-up day each map task to spread them, or they would all hash to one partition.
    """
    day = F.when(F.col(COL_CUSTOMER_ID).isNull(), F.spark_partition_id()).otherwise(text_day(rows, COL_DT))
    return rows.withColumn("day", day).join(keyed, [COL_CUSTOMER_ID, "day"], "left").drop("day")
