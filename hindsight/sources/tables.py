"""Typed table scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.checks import require_columns
from ..schema import wire_schema

_BAD_RECORD = "_bad_record"


def _csv(spark: SparkSession):
    # Quotes inside a quoted cell are doubled, so the escape character is the quote itself.
    # enforceSchema=False compares the header with the schema instead of binding by position.
    return spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)


def read_csv_with_schema(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan CSV files with a header under a declared schema.

    Array columns come back as JSON strings (see ``coerce_impressions_from_json``); a cell that does
    not parse becomes null. The header is compared with the schema for the columns that a query
    reads: reading a column that stands elsewhere in a file fails, a query that needs none of the
    misplaced ones does not.
    """
    return _csv(spark).schema(wire_schema(schema)).csv(path)


def _with_rejects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The typed rows and, in ``_bad_record``, the lines that do not parse.

    The header has no such column, so names cannot be compared here.
    """
    fields = [*wire_schema(schema).fields, StructField(_BAD_RECORD, StringType())]
    reader = _csv(spark).option("columnNameOfCorruptRecord", _BAD_RECORD).option("enforceSchema", True)
    return reader.schema(StructType(fields)).csv(path)


def csv_rejects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines that ``count_bad_rows`` counts, with where they stand: ``file, block_start, line, null_cells``.

    ``file`` and ``block_start`` (the byte where the scan's part of the file begins) come from the scan's own
    metadata, ``null_cells`` names the cells that are empty or do not parse.
    """
    names = wire_schema(schema).names
    rows = _with_rejects(spark, path, schema)
    empty = F.array_compact(F.array(*[F.when(F.col(name).isNull(), name) for name in names]))
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col(_BAD_RECORD).alias("line"),
        empty.alias("null_cells"),
    ).where("line is not null")


def count_bad_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: ``total_rows``, ``bad_rows`` and ``null_<column>`` for each column.

    A bad row is a CSV line with a cell that does not parse, or with too many or too few cells.
    Every column is counted, so that column pruning cannot skip the cells in question. Files whose
    header is not the schema's fail, as all columns are read by name as well.
    """
    typed = wire_schema(schema)
    counts = _with_rejects(spark, path, schema).agg(
        F.count("*").alias("total_rows"),
        F.count(_BAD_RECORD).alias("bad_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in typed.names],
    )
    # Cells as text, bound by a header that has to match; the count of all columns reads each file's.
    text = StructType([StructField(name, StringType()) for name in typed.names])
    named = _csv(spark).schema(text).csv(path)
    seen = named.agg(F.count(F.struct(*typed.names)).alias("seen"), *[F.count(c).alias(f"_{c}") for c in typed.names])
    return counts.where(F.lit(0) <= seen.select(F.expr(" + ".join(["seen", *[f"`_{c}`" for c in typed.names]]))).scalar())


def read_parquet_with_schema(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scan Parquet files; the declared columns are picked by name and keep their stored types."""
    df = spark.read.parquet(path)
    require_columns(df, schema.names, path)
    return df.select(*schema.names)
