"""The four datasets of a run, addressed by explicit paths."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from .impressions_json import coerce_impressions_from_json
from .tables import read_csv_with_schema, read_parquet_with_schema


class SourcePaths(NamedTuple):
    impressions: str
    clicks: str
    add_to_carts: str
    previous_orders: str


class Sources(NamedTuple):
    impressions: DataFrame
    clicks: DataFrame
    add_to_carts: DataFrame
    previous_orders: DataFrame


def load_sources(
    spark: SparkSession, paths: SourcePaths, source_format: str = "csv", flag: str | None = None
) -> Sources:
    """Lazy frames for the four datasets, CSV or Parquet, with the impressions already nested.

    With ``flag``, impressions that arrive as text have a boolean column of that name: whether it could not be parsed.
    """
    readers = {"csv": read_csv_with_schema, "parquet": read_parquet_with_schema}
    if source_format not in readers:
        raise ValueError(f"source_format must be one of {sorted(readers)}, got {source_format!r}")
    read = readers[source_format]
    return Sources(
        coerce_impressions_from_json(read(spark, paths.impressions, schema.impressions_schema), flag=flag),
        read(spark, paths.clicks, schema.clicks_schema),
        read(spark, paths.add_to_carts, schema.add_to_carts_schema),
        read(spark, paths.previous_orders, schema.previous_orders_schema),
    )
