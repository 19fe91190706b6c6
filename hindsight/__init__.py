"""Point-in-time-correct history sequences on Spark."""

from . import constants, schema
from .operators import explode_impressions, normalize_actions, prune_logs
from .plans import (
    action_type_distribution,
    action_type_frequency_by_position,
    action_types_by_position,
    build_training_inputs,
    build_training_inputs_from_days,
    calculate_dq_metrics,
    dq_metrics,
    dq_summary,
    history_entries,
    impression_activity,
    load_action_days,
    merged_action_types,
    merged_sequence_lengths,
    merged_summary,
    merged_types_by_position,
    metrics_by_day,
    run_job,
    save_action_days,
    sequence_length_distribution,
    sequence_lengths,
)
from .sources import (
    SourcePaths,
    bad_impressions,
    coerce_impressions_from_json,
    count_bad_rows,
    csv_rejects,
    load_sources,
    read_csv_with_schema,
    read_parquet_with_schema,
    replace_partitions,
    save_metrics,
    save_training_inputs,
)

__all__ = [
    "SourcePaths",
    "action_type_distribution",
    "action_type_frequency_by_position",
    "action_types_by_position",
    "bad_impressions",
    "build_training_inputs",
    "build_training_inputs_from_days",
    "calculate_dq_metrics",
    "coerce_impressions_from_json",
    "constants",
    "count_bad_rows",
    "csv_rejects",
    "dq_metrics",
    "dq_summary",
    "explode_impressions",
    "history_entries",
    "impression_activity",
    "load_action_days",
    "load_sources",
    "merged_action_types",
    "merged_sequence_lengths",
    "merged_summary",
    "merged_types_by_position",
    "metrics_by_day",
    "normalize_actions",
    "prune_logs",
    "read_csv_with_schema",
    "read_parquet_with_schema",
    "replace_partitions",
    "run_job",
    "save_action_days",
    "save_metrics",
    "save_training_inputs",
    "schema",
    "sequence_length_distribution",
    "sequence_lengths",
]
