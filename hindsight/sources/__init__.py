from .datasets import SourcePaths, load_sources
from .impressions_json import bad_impressions, coerce_impressions_from_json
from .tables import count_bad_rows, csv_rejects, read_csv_with_schema, read_parquet_with_schema
from .writers import replace_partitions, save_metrics, save_training_inputs

__all__ = [
    "SourcePaths",
    "bad_impressions",
    "coerce_impressions_from_json",
    "count_bad_rows",
    "csv_rejects",
    "load_sources",
    "read_csv_with_schema",
    "read_parquet_with_schema",
    "replace_partitions",
    "save_metrics",
    "save_training_inputs",
]
